import numpy as np
import pytest
from pyspark.sql import functions as F

from celstack.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), model).join(labels, "doc_id").where("held_out")
    total, right, clean, kept = scored.agg(F.count("*"), *(F.count_if(F.expr(x)) for x in ("predicted = quality", "quality = 1", "quality = 1 and predicted = 1"))).first()
    assert total > 500 and right / total > 0.97 and kept / clean > 0.99


def test_odd_rows_score_between_0_and_1(documents, odd_rows, model):
    rows = quality.classify(documents(odd_rows), model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert quality.classify(documents([]), model).count() == 0


def test_attention_reads_the_whole_text(documents, model):
    clean, junk = "The river was long and the boats were many. " * 40, "$$$ WIN!! | CASH!! | NOW!! " * 60
    first, tail = quality.classify(documents([(1, clean), (2, clean + junk)]), model).orderBy("doc_id").collect()
    assert first["score"] > tail["score"]
    weights = quality.passage_weights(documents([(2, clean + junk)]), model).collect()
    assert len(weights) == -(-len((clean + junk).encode()) // quality.WINDOW) and abs(sum(r["weight"] for r in weights) - 1) < 1e-6


def test_without_both_classes_the_share_counts(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in quality.classify(documents([(1, "a"), (2, None)]), quality.fit(documents([(1, "a")]), labels)).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags, labels = [rng.normal(size=(n, quality.WIDTH)).astype(np.float32) * 0.2 for n in (1, 3, 2)], np.array([0, 1, 1.0])
    shapes = [(quality.WIDTH, 4), (4, 3), (4, 3), (3,), (4,), (1,)]
    weights = [rng.normal(size=s).astype(np.float64) * 0.5 for s in shapes]

    def loss(w):
        scores = np.array([quality.AttentionModel(*w[:5], float(w[5][0])).score(b) for b in bags])
        return -np.mean(labels * np.log(scores) + (1 - labels) * np.log(1 - scores))

    grads = quality._gradients(weights, bags, labels, decay=0)
    for k, at in ((0, (5, 2)), (1, (1, 1)), (2, (3, 0)), (3, (2,)), (4, (1,)), (5, (0,))):
        up, down = [w.copy() for w in weights], [w.copy() for w in weights]
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - grads[k][at]) < 1e-4
