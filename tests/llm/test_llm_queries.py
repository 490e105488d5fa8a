"""The registered queries: SQL twins where there are any, and the pipeline against its parts."""

import brute
import duckdb
import pytest
from test_documents import check_packing

import __spark_entry__
import corpus_pipeline
from celstack.llm import queries, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.SQL:
        result = con.execute(queries.SQL[name])
        assert canonical(df.columns, rows) == canonical([c[0] for c in result.description], result.fetchall())


def test_registered():
    known = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(known) and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
    assert [n for n in queries.QUERIES if "_" in n] == list(queries.QUERIES) and {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_native_plan(spark):
    plan = queries.QUERIES["op7_temporal_urls"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian"))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted((r["doc_id"], r["text"]) for r in quality.keep_accepted(docs, model).collect())
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, model).collect()}
    assert [i for i, _ in kept] == sorted(i for i, p in scores.items() if p)
    lines = [(i, text) for i, _, _, text in brute.deduped(kept, 10)]
    groups = brute.components(lines, 5, 80, 100)
    left = [(i, t) for i, t in lines if groups[i][1] == i]
    check_packing(corpus_pipeline.run(spark, SF).collect(), left, 1024)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
