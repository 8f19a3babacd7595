"""Registered queries on the smallest tables, against plain versions of what they must return."""

from __future__ import annotations

from reviewlytics.llm.queries import QUERIES
from tests.llm.test_negatives import plain as negatives
from tests.llm.test_runs import plain as runs
from tests.llm.test_urls import plain_rule

SF_DIR = "/root/testdata/sf0.001"


def test_op11(spark):
    got = QUERIES["op11_boosted_url_filter"](spark, SF_DIR)
    types = {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}
    assert dict(got.dtypes).items() >= types.items()
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()
    found = {r["page_id"]: r for r in got.collect()}
    assert len(found) == len(pages) and {r["verdict"] for r in found.values()} <= {"allow", "block"}
    for page_id, url in pages:
        host, path, rule, verdict = plain_rule(url)
        r = found[page_id]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == verdict)


def test_op12(spark):
    got = QUERIES["op12_four_russians_negatives"](spark, SF_DIR)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    assert sorted(tuple(r) for r in got.collect()) == negatives([tuple(r) for r in rows])


def test_op13(spark):
    got = QUERIES["op13_periodic_runs"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    short = {d for d, t in docs if len(t or "") < 20_000}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(docs)
    assert sorted((r for r in found if r[0] in short), key=str) == sorted((runs(d, t) for d, t in docs if d in short), key=str)
