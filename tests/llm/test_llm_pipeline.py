"""The corpus pipeline's stages, and the operators' SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from offerloom.llm import packing, registry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return int(v) if isinstance(v, bool) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    a = sorted([[plain(v) for v in r] for r in df.select(*columns).collect()], key=str)
    b = sorted([[plain(r[i]) for i in place] for r in want.fetchall()], key=str)
    assert a == b


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "", "en", None, 0), (0, docs.where("doc_id = 0").first()["text"], "fr", "src0", 1)], docs.schema)
    now, seen = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        seen.append((name, rows))
        now = spark.createDataFrame(rows, docs.schema)
    first, second, third, mixed = (rows for _, rows in seen)
    assert {90001, 90002} <= {r["doc_id"] for r in third}
    assert len(second) < len(first) and len({r["doc_id"] for r in second}) == len(second)
    assert len(third) <= len(second) and set(mixed) <= set(third)
    packed = corpus_pipeline.pack(spark, now, SF).collect()
    t = packing.tokens(packing.VOCABULARY)
    assert sum(r["n_tokens"] for r in packed) == sum(len(t.of(r["text"] or "")) // t.dtype.itemsize for r in mixed)
    assert all(np.frombuffer(r["ids"], t.dtype).size == packing.ROW_LENGTH for r in packed)


def test_stages_on_empty_tables(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
