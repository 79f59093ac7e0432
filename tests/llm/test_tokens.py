"""Operators 4 and 9 against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import op04_token_counts as op4
from tallyspark.llm import op09_packing as op9
from tallyspark.llm import tokens
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [" ", "  ", "\n", " \n", "\n ", "a", "B9", "'s", "é", "<|endoftext|>", " ", "\t", "_-", "日本", "\x1c", "　", "\r\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12))
def test_ids_are_the_librarys(bits):
    e = tokens.encoder(tokens.default_vocabulary())
    text = "".join(bits)
    assert list(e.ids(text)) == list(e.whole(text))


def test_long_texts_in_parts():
    e = tokens.encoder(tokens.default_vocabulary())
    rnd = random.Random(3)
    text = "".join(rnd.choice(ODD[:-2]) for _ in range(3000)).replace("<|endoftext|>", " x ")
    assert "".join(tokens.parts(text, 50)) == text
    joined = [i for p in tokens.parts(text, 50) for i in e.whole(p)]
    assert joined == e.whole(text)
    run = "z" * 5000 + " y"
    assert e.ids(run) == e.whole(run)


def test_counts_match_library_on_table(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in op4.token_counts(docs).collect()}
    e = tokens.Encoder(tokens.default_vocabulary())
    for r in docs.collect():
        n = len(e.whole(r["text"]))
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"]) == (len(r["text"].encode()), n)
        assert got[r["doc_id"]]["over_limit"] == (n > 1024)


def test_counts_edge_rows(make_docs):
    got = op4.token_counts(make_docs([(1, None), (2, ""), (2, "a b"), (2, "a b"), (None, "x" * 9)], extra=True)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got)[1:] == [(1, 0, 0), (2, 0, 0), (2, 3, 2), (2, 3, 2)]
    assert op4.token_counts(make_docs([])).count() == 0


def _check_packing(placed: pd.DataFrame, capacity: int) -> int:
    for _, g in placed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].iloc[0] == 0
        assert (g["offset"].to_numpy()[1:] == (g["offset"] + g["length"]).to_numpy()[:-1]).all()
        assert g["length"].sum() <= capacity
    return placed["sequence_id"].nunique()


def test_packing_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = op9.pack(docs).toPandas()
    bins = _check_packing(got, 2048)
    assert bins <= -(-got["length"].sum() // 2048) + 2
    e = tokens.Encoder(tokens.default_vocabulary())
    for r in docs.collect():
        ids = np.array([*e.whole(r["text"]), 0], dtype="<u4")
        own = got[got["doc_id"] == r["doc_id"]].sort_values("piece")
        assert own["length"].sum() == len(ids) and (own["length"].iloc[1:] == 2048).all()
        assert list(own["piece"]) == list(range(len(own)))
        for s, n, c in zip(own["start"], own["length"], own["ids_crc32"]):
            assert c == zlib.crc32(ids[s:s + n].tobytes())


def test_packing_edge_rows(make_docs):
    rows = [(1, None), (1, None), (2, ""), (3, "a " * 40), (3, "a " * 40), (4, "b"), (5, "c " * 500)]
    got = op9.pack(make_docs(rows, extra=True), capacity=16).toPandas()
    _check_packing(got, 16)
    assert len(got[got["doc_id"] == 1]) == 2
    assert op9.pack(make_docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_uses_every_piece(histogram):
    used: dict[int, int] = {}
    for combo, times in op9.plan(histogram, 30):
        assert sum(combo) <= 30
        for x in combo:
            used[x] = used.get(x, 0) + times
    assert used == histogram


def test_fullest_is_the_fullest():
    rnd = random.Random(1)
    for _ in range(60):
        have = {rnd.randint(1, 25): rnd.randint(1, 3) for _ in range(5)}
        must = max(have)
        sums = {must}
        for x, n in have.items():
            for _ in range(n - (x == must)):
                sums |= {s + x for s in sums}
        combo = op9.fullest(have, 30, must)
        assert sum(combo) == max(s for s in sums if s <= 30)
        assert all(combo.count(x) <= have[x] for x in combo)
