"""Registered text queries with SQL against it, on the smallest tables."""

import hashlib

import pyarrow.parquet as pq
import pytest

from check import compare, connect
from millrace.llm import pii
from millrace.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ORACLES)
def test_query_equals_sql(spark, key):
    assert compare(QUERIES[key](spark, FOLDER), connect(FOLDER), ORACLES[key]) == ""


def test_personal_data_digests(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, FOLDER).collect()}
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert sorted(got) == sorted(d["doc_id"] for d in docs)
    assert sum(r["n_email"] for r in got.values()) > 0
    for d in docs:
        row, spans = got[d["doc_id"]], pii.spans_of(d["text"] or "")
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        base = ",".join(x for x, (k, _, _) in zip(said, spans) if k < 4)
        assert row["spans"] == ",".join(said) and row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [row[f"n_{x}"] for x in pii.KINDS[:4]] == [sum(k == n for k, _, _ in spans) for n in range(4)]
