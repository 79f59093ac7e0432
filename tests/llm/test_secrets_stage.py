"""The secrets stage replaces whole keys and logins."""

import corpus_pipeline

LINE = "MIIEpAIBAAKCAQEA7bq+/Zk3sd9f8Qw1er5ty7uiOpAsDfGhJkLzXcVbNm012345"
BODY = "\n".join([LINE] * 20)
WANT = "before <secret> after the key"


def pem(kind, body=BODY, end=True):
    return f"-----BEGIN {kind}-----\n{body}\nAb12Cd==" + (f"\n-----END {kind}-----" if end else "\n")


CASES = [
    ("before " + pem("RSA PRIVATE KEY") + " after the key", WANT),
    ("before " + pem("PRIVATE KEY").replace("\n", "\\n") + " after the key", WANT),
    ("before " + pem("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + BODY) + " after the key", WANT),
    ("before " + pem("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\n\n" + BODY + "\n=aB1d") + " after the key", WANT),
    ("before " + pem("EC PRIVATE KEY", "\n".join([LINE] * 5000)) + " after the key", WANT),
    ("before " + pem("EC PRIVATE KEY", end=False) + "some words after it", "before <secret>\nsome words after it"),
    (pem("RSA PRIVATE KEY", end=False) + "and words " + pem("EC PRIVATE KEY") + " end", "<secret>\nand words <secret> end"),
    ("x ftp://" + "u" * 150 + ":" + "p" * 300 + "@host y", "x <secret>host y"),
    ("http://me:pw@host and -----BEGIN PUBLIC KEY-----", "<secret>host and -----BEGIN PUBLIC KEY-----"),
]


def test_whole_secrets_go(spark, make_docs):
    docs = make_docs([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(CASES)])
    got = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want), (i, got[i]["text"][:300])
