"""Queries of the operators against their DuckDB SQL, on the table and on odd texts."""

import duckdb
import pandas as pd
import pytest

from tallyspark.llm import op01_secrets as op1
from tallyspark.llm import oracle, queries
from tests.llm.test_secrets import CASES
from tests.llm.test_secrets_stage import BODY, pem
from tests.llm.test_secrets_stage import CASES as WHOLE
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    res = duck(SF).execute(oracle.oracle_sql()[name])
    ok, msg = compare(queries.queries()[name](spark, SF), res.fetchall(), [d[0] for d in res.description])
    assert ok, msg


def test_secrets_match_their_sql_on_odd_texts(make_docs):
    """Whole keys, with and without END, checksums, short last lines with and without padding, long logins."""
    texts = [t for t in CASES if t is not None] + [t for t, _ in WHOLE] + [
        pem("RSA PRIVATE KEY", end=False).replace("Ab12Cd==", "Ab12Cd") + " x", pem("RSA PRIVATE KEY", end=False).replace("Ab12Cd==", "Ab12Cd") + "\t \n=aB1d z",
        "-----BEGIN PRIVATE KEY-----\n" + BODY + "\nshort", "-----BEGIN PRIVATE KEY-----\\n" + BODY.replace("\n", "\\n") + "\\nAb12\\n=aB1d\\n",
        "-----BEGIN PGP PRIVATE KEY BLOCK----- " * 2, "------BEGIN PRIVATE KEY-----x---y----z------END PRIVATE KEY-----",
        "git+ssh://" + "u" * 400 + ":" + "p" * 400 + "@h http://a:b:c@d"]
    got = {r["doc_id"]: r.asDict() for r in op1.secret_digest(make_docs(list(enumerate(texts)))).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.execute(oracle.oracle_sql()["op1_secrets"]).df().set_index("doc_id")
    for k, text in enumerate(texts):
        assert got[k]["spans"] == want.loc[k, "spans"], (text[:80], got[k]["spans"], want.loc[k, "spans"])
        assert got[k]["base_sha256"] == want.loc[k, "base_sha256"]
    spans = {k: got[k]["spans"] for k in got}
    assert any(f"url_login:0:{10 + 400 + 1 + 400 + 1}" in s for s in spans.values())
    assert any(s.startswith("private_key:0:1") and len(s) < 25 for s in spans.values())
