"""Operator 1 against Python's re, and the ledger's increments."""

import hashlib
import re

import pytest

from tallyspark.llm import op01_secrets as op1
from tallyspark.llm.common import shared_path, table

BASE = [("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(BASE)
             for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


CASES = [
    None, "", "no secret", 'token: "secret": "abcdefgh12"', "PassWord = 'abcdefgh' api_key=12345678 apikey:x", "é" * 5 + "token=" + "a1b2" * 8,
    "AKIA" + "A" * 11, "AKIA" + "A" * 12 + " AKIAAKIAAKIAAKIA", "f" * 31 + " " + "0" * 32 + "g", "token=token=abcdefgh",
    "日本 secret =  x secret='zzzzzzzz'" * 400, "token = \"" + "ab" * 20 + "\"", "ghp_" + "a" * 36, "http://me:pw@host -----BEGIN RSA PRIVATE KEY-----",
    "api__key=abcdefghij", "passwd\n=abcdefghij", "secret::abcdefghij",
]


def test_cases_match_brute_force(make_docs):
    docs = make_docs([(i, t) for i, t in enumerate(CASES)] + [(5, CASES[5]), (None, "token=abcdefgh")], extra=True)
    for r in op1.secret_digest(docs).collect():
        want = brute(CASES[r["doc_id"]] if r["doc_id"] is not None else "token=abcdefgh")
        own = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert own == want, (r["doc_id"], own[:200], want[:200])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert r["n_hex"] == want.count("hex:")
    assert op1.secret_digest(make_docs([])).count() == 0


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    got = op1.secret_digest(docs).collect()
    assert len(got) == len(texts) and any(r["spans"] for r in got)
    for r in got:
        assert r["base_sha256"] == hashlib.sha256(brute(texts[r["doc_id"]]).encode()).hexdigest()


def test_ledger_scans_only_unseen_pairs(spark, make_docs):
    ledger = shared_path(spark, "test-ledger")
    first = make_docs([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")])
    op1.scan(first, ["doc_id"], ledger).collect()
    assert op1.read_ledger(spark, ledger).count() == 2
    second = make_docs([(4, "token=abcdefgh"), (5, "f" * 40)])
    got = {r["doc_id"]: len(r["spans"]) for r in op1.scan(second, ["doc_id"], ledger).collect()}
    assert got == {4: 1, 5: 1} and op1.read_ledger(spark, ledger).count() == 3
    rules = (*op1.RULES[:2], op1.Rule("hex", 2, r"[0-9a-f]{8,}"), *op1.RULES[3:])
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in op1.scan(second, ["doc_id"], ledger, rules).collect()}
    rows = op1.read_ledger(spark, ledger).filter("array_contains(pairs, 'hex@2')").collect()
    assert {tuple(r["pairs"]) for r in rows} == {("hex@2",)} and len(rows) == 2
    assert got == {4: ["assign", "hex"], 5: ["hex"]} or got == {4: ["assign"], 5: ["hex"]}


@pytest.mark.parametrize("text,want", [("a token=abcdefgh b", "a <secret> b"), ("token=abcdefgh", "<secret>"), ("clean", "clean"),
                                       ("x " + "f" * 40 + " y token='" + "e" * 32 + "' z", "x <secret> y <secret>' z")])
def test_redact(spark, make_docs, text, want):
    rows = op1.scan(make_docs([(1, text)]), ["doc_id"], with_text=True)
    assert rows.select(op1.redact(rows["text"], rows["spans"]).alias("t")).first()["t"] == want
