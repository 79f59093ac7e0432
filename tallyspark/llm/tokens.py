"""Exact token ids of a ``tokenizers`` vocabulary.

For a byte-level vocabulary whose ids are the order of its merges, ``tiktoken``
gives the same ids several times faster; tests compare the two.  Where no two
white-space characters touch, the library's split needs no look-ahead, and a
plainer pattern makes the same cuts.  Texts that hold the text of a special
token, and texts with very long runs without white space, go to ``tokenizers``
itself.

Byte-level vocabularies always split in front of a single space that is
followed by something other than white space, so a long text is cut there and
encoded part by part.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Two white-space characters that touch: only there the library's look-ahead matters.
TOUCHING = re.compile(r"\s\s")
#: Its pattern without the look-ahead.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Runs without white space longer than this go to ``tokenizers``, whose merging doesn't slow down with length.
LONG_RUN = 500
#: A text is encoded in parts of about so many characters.
PART_CHARS = 100_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 byte values."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _rank_encoders(path: str):
    """``tiktoken`` encodings of the file's vocabulary (full and plain pattern), or None where the file isn't of that kind."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if model.get("type") not in (None, "BPE") or spec.get("normalizer") or pre.get("type") != "ByteLevel" \
            or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("continuing_subword_prefix") \
            or model.get("end_of_word_suffix"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte, vocab = _byte_of_char(), {k: v for k, v in model["vocab"].items() if k not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab.get(a + b) for a, b in merges]
    if None in ids or ids != sorted(ids) or len(merges) + 256 != len(vocab):
        return None
    ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
    return [tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for name, pattern in (("full", public_tokenizers.PATTERN), ("plain", PLAIN))]


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a text before single spaces, at least ``size`` characters apart; the ids of the parts join up to the text's.

    A cut needs a space with no white space on either side.
    """
    if len(text) <= size:
        return [text]
    out, start = [], 0
    for m in re.finditer(r"(?<=\S) (?=\S)", text):
        if m.start() - start >= size:
            out.append(text[start:m.start()])
            start = m.start()
    return [*out, text[start:]]


class Encoder:
    """Ids of whole texts, as the library gives them without added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks = _rank_encoders(path)

    def whole(self, text: str) -> list[int]:
        """The library's ids."""
        return self.tok.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        """All ids of a text."""
        if not text:
            return []
        if self.ranks is None or any(s in text for s in self.special):
            return self.whole(text)
        out: list[int] = []
        for part in parts(text):
            if max(map(len, part.split()), default=0) > LONG_RUN:
                out += self.whole(part)
            else:
                out += self.ranks[TOUCHING.search(part) is None].encode_ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
