"""Operator 11 against trees built node by node in plain Python."""

import hashlib
import zlib

import pytest

from tallyspark.llm import op11_merkle as op11
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, tamper=False):
    fields = [row[0], row[3], row[2], row[4], row[1]]
    if tamper and fields[-1] is not None:
        fields[-1] = fields[-1].translate(LOWER)
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """(root, siblings per leaf as [(left, right)])."""
    paths, at, own = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(own) > 1:
        for k, place in enumerate(at):
            first = place - place % 8
            paths[k].append(("".join(own[first:place]), "".join(own[place + 1:first + 8])))
        own = [sha("".join(own[a:a + 8])) for a in range(0, len(own), 8)]
        at = [p // 8 for p in at]
    return own[0], paths


def brute(rows):
    """Result rows from (doc_id, text, lang, source, n_chars)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[2] for x in langs[name]])
    if not names:
        return []
    root, upper = tree([trees[n][0] for n in names])
    out = []
    for name, above in zip(names, upper):
        for (_, _, own, r), path in zip(langs[name], trees[name][1]):
            whole = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf_of(r, True) if tampered else own
            for a, b in whole:
                h = sha(a + h + b)
            out.append((r[0], own, trees[name][0], root, sha("".join(a + b for a, b in whole)), h, h == root))
    return sorted(out, key=str)


def result(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    got = result(op11.manifest(docs))
    assert got == brute(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_several_rounds_and_one_large_language(make_docs):
    """Over 512 x 2 leaves in one language, a block that ends in one node of one, and trees of 1, 8, 9, 512 and 513 leaves."""
    sizes = {"de": 1025, "a": 1, "b": 8, "c": 9, "d": 512, "e": 513}
    rows = [(k * 7, f"T {k} É", name, "s", k) for name, n in sizes.items() for k in range(n)]
    assert result(op11.manifest(make_docs(rows))) == brute(rows)


def test_odd_rows(make_docs):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (3, None, "", None, 1), (3, "", "", None, 1),
            (5, "SAME", "en", "s", 4), (5, "SAME", "en", "s", 4), (5, "SAME", "en", "s", 4), (6, "Ünï", "é", "S", 3),
            (7, "Long " * 100_000, "é", "S", 3), (-1, "x", "=", "S", None)]
    assert result(op11.manifest(make_docs(rows))) == brute(rows)
    extra = make_docs(rows, extra=True)
    for c in ("tree", "digest", "pos", "size", "slice_", "level0", "path", "a.b", "Root"):
        extra = extra.withColumn(c, op11.F.lit(1))
    assert result(op11.manifest(extra)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(make_docs, n):
    rows = [(9, "A", "en", "s", 1)][:n]
    got = result(op11.manifest(make_docs(rows)))
    assert got == brute(rows)
    if n:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
