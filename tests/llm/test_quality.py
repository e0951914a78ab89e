"""Quality by nnPU: held-out accuracy on the given tables, equal texts score equal, odd inputs."""

import numpy as np
import pandas as pd

from outletry.llm import quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.quality(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert rows and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["quality"] == r["predicted"] for r in rows) / len(rows) >= 0.85


def test_nnpu_separates_and_keeps_the_risk_non_negative():
    rng = np.random.default_rng(0)

    def frame(texts, y):
        pairs = [quality.features(t) for t in texts]
        return pd.DataFrame({"y": y, "idx": [p[0] for p in pairs], "val": [p[1] for p in pairs]})

    good = [" ".join(rng.choice(["the", "river", "runs", "past", "a", "town"], 30)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(["the", "river", "runs"], 30)) for _ in range(20)]
    w = quality.fit_nnpu(frame(good[:40], 1), frame(good[40:] + bad, -1), prior=0.5, steps=100)
    score = lambda t: float(np.dot(w[quality.features(t)[0]], quality.features(t)[1]) + w[-1])
    assert min(map(score, good[40:])) > max(map(score, bad))


def test_odd_inputs(make_docs, spark):
    texts = [None, "", "Same text here.", "Same text here.", "A" * 100_000]
    docs = make_docs(texts).withColumn("score", quality.F.lit("x")).withColumn("one", quality.F.lit(2))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(rows) == 5 and rows[2]["score"] == rows[3]["score"]
    assert rows[0]["score"] == rows[1]["score"]
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0
