r"""Chat formatting by a finite-state machine over roles (operator 8).

A conversation becomes one text by a declarative ``Template``: every turn is
``### role: text</turn>`` and a line end.  Inside roles and texts, control
strings and backslashes get a backslash before them, which the reader takes
away again, so any text survives.  A state machine over the roles validates the
order of turns (``ORDER``); a conversation that breaks it is formatted all the
same and flagged from that turn on.

The output has one row per turn with its formatted text, split in segments
with a loss flag each: marks never, texts if the role is one of
``Template.learn``.  Rows of a conversation come in order of turn (ties: role,
then text).  Formatting and reading back run over sorted partitions as streams
and hold one turn at a time, so a conversation with a third of all rows needs
no more memory than a short one.  (Its digests are sequential hashes; they
can't be split among tasks.)

Null roles and texts count as empty, a null conversation id is a conversation
of its own.  Repeated rows are turns of their own.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

#: Role -> roles that may come before it; None is the beginning.
ORDER = {"system": {None}, "user": {None, "system", "assistant", "tool"}, "assistant": {"user", "tool"}, "tool": {"assistant"}}


@dataclass(frozen=True)
class Template:
    """Marks of a turn; ``learn`` names the roles whose texts the loss counts."""
    begin: str = "### "
    colon: str = ": "
    end: str = "</turn>"
    after: str = "\n"
    learn: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ["\\", *self.controls])), lambda m: "\\" + m[0], text)

    @property
    def controls(self) -> list[str]:
        """What has to be escaped inside roles and texts: the marks without the space around them."""
        return [m.strip() for m in (self.begin, self.colon, self.end)]

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) of a turn; joined they are its formatted text."""
        return [(self.begin + self.escape(role) + self.colon, False), (self.escape(text), role in self.learn),
                (self.end + self.after, False)]

    @property
    def turn(self) -> re.Pattern:
        """A formatted turn: role and text, still escaped.  Marks inside them always have a backslash before them."""
        def upto(mark: str) -> str:
            first = re.escape(mark[0])
            return rf"((?:[^\\{first}]+|\\.|{first}(?!{re.escape(mark[1:])}))*){re.escape(mark)}"
        return re.compile(re.escape(self.begin) + upto(self.colon) + upto(self.end) + re.escape(self.after), re.S)


def next_ok(before: str | None, role: str) -> bool:
    """Whether the machine has an edge for ``role`` after the state ``before``."""
    return before in ORDER.get(role, ())


_TURN_SCHEMA = "conv_id long, turn long, formatted string, loss array<struct<start:bigint,end:bigint>>, order_ok boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, ok, began = None, None, True, False
        for batch in batches:
            rows = []
            for c, t, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not began or c != conv:
                    conv, before, ok, began = c, None, True, True
                role, text = role or "", text or ""
                ok = ok and next_ok(before, role)
                before, at, spans, out = role, 0, [], []
                for piece, loss in template.segments(role, text):
                    if loss:
                        spans.append({"start": at, "end": at + len(piece)})
                    out.append(piece)
                    at += len(piece)
                rows.append((c, t, "".join(out), spans, ok))
            types = [pa.int64(), pa.int64(), pa.string(), _SPANS, pa.bool_()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["conv_id", "turn", "formatted", "loss", "order_ok"])
    return run


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, formatted, loss, order_ok) per turn, the turns of a conversation in order and in one partition.

    ``loss`` has the places (code points within ``formatted``) that the loss counts.
    """
    prepare(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").alias("role"), F.col("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(template), _TURN_SCHEMA)


class _Digest:
    """Reads the formatted text of one conversation, chunk by chunk."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.turn
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.open, self.ok = "", True

    def feed(self, chunk: str, spans: list[dict], ok: bool) -> None:
        for s in spans:
            text = self.template.unescape(chunk[s["start"]:s["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(chunk)
        self.ok = self.ok and ok
        self.open += chunk
        at = 0
        while m := self.pattern.match(self.open, at):
            role, text = map(self.template.unescape, m.groups())
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
            at = m.end()
        self.open = self.open[at:]

    def row(self, conv: int | None) -> tuple:
        if self.open:
            raise ValueError(f"conversation {conv}: {self.open[:80]!r} is no turn")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok


def _read_back(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_ok"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, _, chunk, spans, ok in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if digest is None or c != conv:
                    if digest is not None:
                        done.append(digest.row(conv))
                    conv, digest = c, _Digest(template)
                digest.feed(chunk, spans, ok)
            yield batch_of(done)
        if digest is not None:
            yield batch_of([digest.row(conv)])
    return run


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of every conversation, read from what ``format_turns`` gives (same partitions, same order)."""
    return turns.mapInArrow(_read_back(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                  "loss_sha256 string, formatted_chars long, order_ok boolean")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """The registered query: all conversations and conversation -7, formatted and read back."""
    spark = conversations.sparkSession
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_turns(rows.unionByName(extra)))
