"""Operator 2 against all pairs, with small regions so that every level runs."""

import random
import re

import pytest

from tallyspark.llm import op02_jaccard_join as op2
from tallyspark.llm.common import table


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x
    inv = {}
    for k, s in enumerate(sets):
        for x in s:
            inv.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        count = {}
        for x in s:
            for j in inv[x]:
                if j < k:
                    count[j] = count.get(j, 0) + 1
        for j, n in count.items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                comp[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i if i is not None else -99, len(sets[k]), least.get(root(k), -99) if sets[k] else (i if i is not None else -99))
                  for k, (i, _) in enumerate(rows))


def run(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -99)
                  for r in op2.join_components(df).collect())


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert run(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(make_docs):
    long = "very long text " * 20_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (7, "one two three"),
            (8, "One\tTWO\x0bthree"), (9, long), (10, long + "x"), (None, "one two"), (None, "alone here now"), (11, "é É"), (12, "É é"),
            (13, "a\xa0b c d"), (13, "other text under this id")]
    assert run(make_docs(rows, extra=True)) == brute(rows)
    assert op2.join_components(make_docs([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_chains(make_docs, monkeypatch, seed):
    """Chains of edits, hubs of near copies and shared passages; regions of more than 3 documents are split."""
    monkeypatch.setattr(op2, "SMALL", 3)
    monkeypatch.setattr(op2, "SPREAD", 100 if seed == 1 else 2)
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(6):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([40, 120, 200]))]
        if rnd.random() < 0.5:
            base[10:10] = passage
        cur = base
        for k in range(25):
            cur = list(cur if rnd.random() < 0.4 else base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                cur[rnd.randrange(len(cur))] = rnd.choice(vocab)
            texts.append(" ".join(cur))
    texts += [" ".join(passage[: rnd.randint(50, 60)]) for _ in range(20)] + [" ".join(rnd.choices(vocab, k=30)) for _ in range(30)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(make_docs(rows)) == brute(rows)


def test_keep_one(make_docs):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "other words stand here"), (1, None), (2, None), (9, "same id but a new text"),
            (None, "a b c d e"), (None, "no id here at all"), (None, "no id here at all"), (4, " \n")]
    kept = op2.keep_one(make_docs(rows, extra=True).withColumnRenamed("hash", "least"))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [
        ("1", ""), ("2", ""), ("3", "a b c d e"), ("4", " \n"), ("9", "other words stand here"), ("9", "same id but a new text"),
        ("None", "no id here at all")]
