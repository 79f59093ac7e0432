"""The pipeline's stages against brute force on whole tables."""

import re
import zlib

import numpy as np

import corpus_pipeline
from tallyspark.llm import op06_language, tokens
from tallyspark.llm import op10_decontamination as op10
from tallyspark.llm.common import table
from tests.llm.test_near_copies import least
from tests.llm.test_secrets import BASE

SF = "/root/testdata/sf0.01"


def languages(rows):
    """Kept ids, with counts learned row by row."""
    learn = [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({x for _, x in learn})
    total = np.zeros((len(langs), op06_language.BUCKETS), dtype=np.int64)
    for t, x in learn:
        np.add.at(total[langs.index(x)], op06_language.trigrams([t])[0], 1)
    model = op06_language.Model(langs, total)
    kept = set()
    for i, t, _ in rows:
        scores = model.word_scores([t])[0]
        if len(scores) and op06_language.mixture(scores)[1].max() >= 0.5:
            kept.add(i)
    return kept


def readings(text):
    """The tokens of a text and their templates in each reading of the decontamination stage."""
    raw = [w for w in text.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    core = [w if re.match("[0-9A-Za-z]", w) else w.lstrip(op10.LEADS) for w in raw]
    digit = lambda w: "0" <= w[:1] <= "9"
    plain, wide, words = [], [], []
    for i, w in enumerate(raw):
        low, before = w.lower(), raw[i - 1] if i else ""
        word = low.rstrip(op10.MARKS)
        name = i and "A" <= w[0] <= "Z" and w != w.upper() and before[-1] not in ".!?"
        plain.append("<num>" if digit(low) else "<name>" if name else "<unit>" if i and digit(before) and word in op10.UNITS else word)
        own, word = core[i], core[i].lower().rstrip(op10.WIDE_MARKS)
        name = own != own.lower() and own[0] != own[0].lower() and own != own.upper() and word not in op10.FUNCTION_WORDS
        wide.append("<num>" if digit(own) else "<name>" if name else "<unit>" if i and digit(core[i - 1]) and word in op10.UNITS else word or low)
        words.append(low.lstrip(op10.QUOTES).rstrip(op10.WIDE_MARKS) or low)
    return raw, {"plain": plain, "wide": wide, "words": words}


def item_windows(items):
    """Templates of a window -> its places: (item, reading, place, its tokens, windows of the item)."""
    out = {}
    for text in set(items):
        raw, kinds = readings(text)
        size, found = min(8, len(raw)), {}
        for reading, own in kinds.items():
            for p in range(len(own) - size + 1 if own else 0):
                if reading == "words" or sum(not x.startswith("<") for x in own[p:p + size]) >= 4:
                    found.setdefault(reading, []).append(p)
        if len(found) > 1:
            found.pop("words")
        for reading, places in found.items():
            for p in places:
                own = tuple(kinds[reading][p:p + size])
                for w in {own, ("<unit>", *own[1:]) if p == 0 and reading != "words" and own[0] in op10.UNITS else own}:
                    out.setdefault((reading, w), []).append((text, p, raw[p:p + size], len(places)))
    return out


def leaked(text, windows):
    raw, kinds = readings(text)
    value = lambda w: w.lstrip(op10.LEADS).rstrip(op10.WIDE_MARKS)
    found, total = {}, {}
    for size in {len(w) for _, w in windows}:
        for reading, own in kinds.items():
            for at in range(len(own) - size + 1):
                for item, place, item_raw, n in windows.get((reading, tuple(own[at:at + size])), ()):
                    pairs = {(value(a), value(b)) for k, a, b in zip(own[at:at + size], item_raw, raw[at:at + size]) if k.startswith("<")}
                    if len({a for a, _ in pairs}) == len(pairs):
                        key = (item, reading, at - place if reading == "words" else None)
                        found.setdefault(key, set()).add(place)
                        total[key] = n
    return any(len(p) / total[k] >= (1 if k[1] == "words" else 0.5) for k, p in found.items())


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    out, text = {}, {i: t for i, t, _ in rows}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test")
        out[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: sorted(r["doc_id"] for r in df.select("doc_id").collect()) for name, df in out.items()}
    kept = languages(rows)
    assert ids["language"] == sorted(kept)
    kept = set(least([(i, text[i]) for i in sorted(kept)]))
    assert ids["near_duplicates"] == sorted(kept)
    windows = item_windows(items)
    bad = {i for i in kept if leaked(text[i], windows)}
    kept -= bad
    assert bad and ids["decontamination"] == sorted(kept) == ids["secrets"]
    for r in out["secrets"].collect():
        want = text[r["doc_id"]]
        if r["text"] != want:
            assert "<secret>" in r["text"] and r["n_chars"] == len(r["text"])
            assert all(len(m.group(g)) < least for _, p, g, least in BASE for m in p.finditer(r["text"]))
        else:
            assert all(len(m.group(g)) < least for _, p, g, least in BASE for m in p.finditer(want))
    e = tokens.Encoder(tokens.default_vocabulary())
    sizes = {r["doc_id"]: len(e.whole(r["text"])) + 1 for r in out["secrets"].collect()}
    got = out["packing"].toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == sizes
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 2048 and len(used) <= -(-sum(sizes.values()) // 2048) + 2
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, again[key].to_numpy()))


def test_stages_take_odd_rows_and_empty_tables(spark, make_docs):
    rows = [(1, None, None), (2, "", "en"), (None, "words without id", "en"), (3, "some words here", None), (3, "some words here", "en"),
            (4, "token=abcdefghij and more words", "en"), (5, "x " * 30_000, "en")]
    for docs in (make_docs(rows), make_docs([])):
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
        docs.collect()
