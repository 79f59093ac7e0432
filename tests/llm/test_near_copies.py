"""The pipeline's near-duplicate stage against all pairs at five words and 0.8."""

import random
import re

import corpus_pipeline
from tallyspark.llm import op02_jaccard_join as op2
from tallyspark.llm.common import table


def shingles(text, size):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def pairs(texts, size, share):
    """Pairs of places in ``texts`` that are near copies."""
    sets, inv, out = [shingles(t, size) for t in texts], {}, []
    for k, s in enumerate(sets):
        count = {}
        for x in s:
            for j in inv.setdefault(x, []):
                count[j] = count.get(j, 0) + 1
            inv[x].append(k)
        out += [(j, k) for j, n in count.items() if 100 * n >= share * (len(s) + len(sets[j]) - n)]
    return out


def least(rows, size=5, share=80):
    """Ids that stay: the least of each component, and all without words."""
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for j, k in pairs([t for _, t in rows], size, share):
        a, b = sorted((root(rows[j][0]), root(rows[k][0])))
        comp[b] = a
    return sorted(i for i in comp if comp[i] == i)


def stage(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())


def test_stage_on_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = least(rows)
    assert want != least(rows, 3, 90)
    assert stage(spark, docs) == want


def test_stage_on_edited_copies(spark, make_docs, monkeypatch):
    """Copies on both sides of 0.8, short texts, and regions of more than 3 documents split."""
    monkeypatch.setattr(op2, "SMALL", 3)
    rnd = random.Random(5)
    vocab, texts = [f"w{k}" for k in range(300)], ["", None, "one", "ONE", "one two three four", "one two three four five", "one two three"]
    for _ in range(8):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([30, 90, 160]))]
        for _ in range(15):
            cur = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                cur[rnd.randrange(len(cur))] = rnd.choice(vocab)
            texts.append(" ".join(cur))
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = least(rows)
    assert want != least(rows, 3, 90)
    assert stage(spark, make_docs(rows)) == want
