"""Operator 5 against a Python version, and its likeness against the true one."""

import hashlib
import math

import xxhash

from tallyspark.llm import op05_fingerprints as op5
from tallyspark.llm.common import table


def shingles(text):
    w = [x for x in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def least_per_bin(text):
    out = {}
    for s in shingles(text):
        h = 42
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        signed = h - (1 << 64) if h >> 63 else h
        b = h >> (64 - op5.BINS_LOG2)
        out[b] = min(out.get(b, signed), signed)
    return out


def edits(rows):
    """(id -> edited text) by the contract: the next id's text, the first after the last."""
    ids = sorted({i for i, _ in rows if i is not None})
    least = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 4
        nxt = least[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else ""
        out.append((i, t[:len(t) - k] + nxt[:k]))
    return out


def test_table_against_python(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts, edited = dict(rows), dict(edits(rows))
    got = {r["doc_id"]: r for r in op5.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    err = []
    for i, r in got.items():
        assert r["n_chars"] == len(texts[i])
        assert r["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
        bits = [int(r["fingerprint"][k:k + 2], 16) for k in range(0, 2 * op5.BINS, 2)]
        own = least_per_bin(texts[i])
        assert all(bits[b] == h & 255 for b, h in own.items())
        assert set(bits) <= {h & 255 for h in own.values()}
        a, b = shingles(texts[i]), shingles(edited[i])
        if len(a) > 100:
            err.append(r["near_edited"] - len(a & b) / len(a | b))
    assert abs(sum(err) / len(err)) < 0.02 and math.sqrt(sum(e * e for e in err) / len(err)) < 0.08


def test_edge_rows(make_docs):
    rows = [(5, "same words in both of them here"), (9, "same words in both of them here"), (-3, None), (1 << 40, ""), (7, "one"),
            (7, "two words"), (None, "abcdefgh"), (6, "é" * 9 + " x"), (8, "w " * 30_000)]
    got = op5.fingerprints(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    want = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in edits(rows)}
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} == want
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[9]["fingerprint"] != ""
    assert by[-3]["fingerprint"] == "" and by[1 << 40]["near_next"] == 1.0 and by[-3]["near_next"] == 0.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert op5.fingerprints(make_docs([])).count() == 0
    one = op5.fingerprints(make_docs([(4, "alone at home and so on now")])).first()
    assert one["near_next"] == 1.0


def test_successors_of_any_ids(spark):
    import random
    rnd = random.Random(5)
    ids = sorted({rnd.choice([rnd.randint(-2**63, 2**63 - 1), rnd.randint(0, 9000), rnd.randint(-70000, 70000)]) for _ in range(3000)})
    got = dict(op5.successors(spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert got == dict(zip(ids, [*ids[1:], None]))
