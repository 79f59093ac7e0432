"""Operator 12 against all windows of 35 words, compared as tuples."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import op12_substring_dedup as op12
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"
N = 35


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + N]) for w in words for i in range(len(w) - N + 1))
    out = []
    for (key, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - N + 1):
            if seen[tuple(w[i:i + N])] > 1:
                gone[i:i + N] = [True] * N
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def test_cover_aligns_any_two_places():
    for a in range(op12.PERIOD):
        for b in range(op12.PERIOD):
            assert any((a + s) % op12.PERIOD in op12.COVER and (b + s) % op12.PERIOD in op12.COVER for s in range(op12.PERIOD))
    assert op12.ANCHOR + op12.PERIOD - 1 == op12.LENGTH


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = result(op12.kept_texts(docs))
    assert got == brute(rows)
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def passages():
    """Texts that share runs of 33 to 37 words at all shifts, repeat inside themselves and hold one word over and over."""
    rnd = random.Random(12)
    fresh = iter(range(10**6))
    word = lambda: f"w{next(fresh)}"
    rows = []
    for n in range(33, 38):
        for shift in (0, 1, 5, 20):
            run = [word() for _ in range(n)]
            for k in range(2):
                rows.append([word() for _ in range(shift * k + 3)] + run + [word() for _ in range(rnd.randint(0, 40))])
    rows += [["a"] * n for n in (34, 35, 36, 100)]
    own = [word() for _ in range(40)]
    rows.append(own + [word()] + own)
    rows += [[rnd.choice("ab") for _ in range(400)] for _ in range(4)]
    near = [word() for _ in range(120)]
    rows += [near[:k] + [word()] + near[k + 1:] for k in (0, 34, 35, 60, 85, 119)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_passages_and_odd_rows(make_docs):
    rows = passages()
    rows += [(None, None), (1, ""), (1, " \t\n"), (2, rows[0][1]), (2, rows[0][1]), (None, rows[9][1].replace(" ", "\x0b\r\n")),
             (7, " ".join(["é  x"] * 36)), (8, "Case " * 35), (9, "case " * 35), (10, " ".join(map(str, range(40)))),
             (11, "\x1c ".join(map(str, range(40))))]
    want = brute(rows)
    docs = make_docs(rows, extra=True)
    for c in ("k1", "k2", "h", "at", "copies", "single", "lone", "n_words", "Text_", "a.b"):
        docs = docs.withColumn(c, op12.F.lit(1))
    assert result(op12.kept_texts(docs)) == want
    assert result(op12.kept_texts(make_docs([]))) == []


def test_long_texts_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(op12, "PART", 200)  # the driver's own process, where the functions below run
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abc") * rnd.randint(1, 3) for _ in range(n)).encode() for n in (3, 0, 900, 20, 50, 1, 2000, 36)]
    for size in (op12.ANCHOR, op12.LENGTH):
        got = Counter()
        for (h,), text, place in op12.blocks(texts, size, (0,)):
            at = op12.starts_of(text, size)
            got.update(zip(text[at].tolist(), place[at].tolist(), op12.window_hashes(h, at, size, 0).tolist()))
        want = Counter()
        for k, t in enumerate(texts):
            h, _ = op12.word_hashes([t], 0)
            at = np.arange(max(0, len(h) - size + 1))
            want.update(zip([k] * len(at), at.tolist(), op12.window_hashes(h, at, size, 0).tolist()))
        assert got == want


def test_very_long_text(make_docs):
    rnd = random.Random(8)
    long = " ".join(str(rnd.randrange(10**7)) for _ in range(400_000))
    assert len(long) > 2 * op12.PART
    inside = " ".join(long.split()[300_000:300_050])
    rows = [(1, long), (2, "x " + inside + " y")]
    assert result(op12.kept_texts(make_docs(rows))) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 200), st.data())
def test_candidates_and_cover(n, data):
    places = op12.anchor_places(n)
    assert places.tolist() == [p for p in range(n - op12.ANCHOR + 1) if p % op12.PERIOD in op12.COVER]
    single = np.array(sorted(data.draw(st.sets(st.sampled_from(places.tolist() or [0]))) if len(places) else []), dtype=np.int64)
    left = set(places.tolist()) - set(single.tolist())
    want = [any(p in left for p in range(i, i + op12.PERIOD)) for i in range(max(0, n - N + 1))]
    assert op12.candidates(n, single).tolist() == want
    starts = np.flatnonzero(want)
    assert op12.covered(n, starts).tolist() == [any(i <= w < i + N for i in starts) for w in range(n)]
