"""Document quality by positive-unlabelled learning with the non-negative risk estimator (nnPU).

Trusted positives are labelled documents of quality 1; the unlabelled set is web text as it comes, drawn
from all learnable documents whatever their label. The class prior ``pi`` is the share of quality 1 among
all learnable labels, counted over the whole table. A linear model ``g`` on hashed features minimises

    pi * E_P[sig(-g)] + max(0, E_U[sig(g)] - pi * E_P[sig(g)])

where ``sig`` is the sigmoid loss; when the negative part drops below zero the step goes against it, as the
estimator asks. The fit uses bounded samples of ``MAX_POSITIVES`` positives and ``MAX_UNLABELLED``
unlabelled documents, each the first by a hash of doc_id, so it is the same on every run and size; it runs in
one task on that bounded sample. Every document is then scored in Arrow batches with the weights broadcast
(``DIM`` floats, whatever the corpus size).

Features: lower-cased words and runs of two or more marks (``***``, ``!!``), hashed into ``DIM`` slots with
crc32 and weighted by their share of the document's words, plus a few dense ratios (capitals, words in
capitals, marks, digits, mean word length, log length).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.llm.shipping import ship

#: Fixed values of the task: a document is held out where crc32(doc_id as text) mod 5 is 0; threshold.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Documented bounds of the fit's samples, and the model's size and steps.
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 8_000
DIM = 1 << 18
DENSE = 8
STEPS = 150
RATE = 0.1
L2 = 1e-5

_MARKS = re.compile(r"[^\w\s]{2,}")
_CAPS = re.compile(r"\b[A-Z]{2,}\b")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[^\w\s]")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one text: slot numbers and values. Null or empty text gives the dense part only."""
    text = text or ""
    words = text.split()
    n = len(words)
    chars = max(1, len(text))
    dense = [
        len(_UPPER.findall(text)) / chars,
        len(_CAPS.findall(text)) / max(1, n),
        len(_MARK.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        min(sum(map(len, words)) / max(1, n), 30) / 10,
        math.log1p(n) / 10,
        len(_MARKS.findall(text)) / max(1, n),
        1.0 if n == 0 else 0.0,
    ]
    counts = Counter(w.lower() for w in words)
    counts.update("~" + m for m in _MARKS.findall(text))
    idx = [DENSE + zlib.crc32(k.encode("utf-8", "surrogatepass")) % (DIM - DENSE) for k in counts]
    val = [v / max(1, n) for v in counts.values()]
    return np.array(list(range(DENSE)) + idx, dtype=np.int64), np.array(dense + val, dtype=np.float64)


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 modulo 5 (null id: held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def _featurise(batches):
    for b in batches:
        pairs = [features(t if isinstance(t, str) else None) for t in b["text"]]
        yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "idx": [p[0] for p in pairs], "val": [p[1] for p in pairs]})


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = frame["idx"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(frame)), lengths)
    cols = np.concatenate(list(frame["idx"])) if len(frame) else np.zeros(0, np.int64)
    vals = np.concatenate(list(frame["val"])) if len(frame) else np.zeros(0)
    return rows, cols, vals


def fit_nnpu(pos: pd.DataFrame, unl: pd.DataFrame, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights (last slot: bias) minimising the non-negative PU risk with the sigmoid loss, by Adam."""
    w = np.zeros(DIM + 1)
    if not len(pos) or not len(unl):
        return w
    pr, pc, pv = _matrix(pos)
    ur, uc, uv = _matrix(unl)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def margin(r, c, val, n):
        return np.bincount(r, weights=val * w[c], minlength=n) + w[-1]

    def grad(r, c, val, coef):
        g = np.bincount(c, weights=val * coef[r], minlength=DIM + 1)
        g[-1] += coef.sum()
        return g

    for t in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-margin(pr, pc, pv, len(pos))))
        su = 1 / (1 + np.exp(-margin(ur, uc, uv, len(unl))))
        d_pos_plus = -sp * (1 - sp) * prior / len(pos)  # d/dg of prior * mean sig(-g)
        d_pos_minus = sp * (1 - sp) * prior / len(pos)  # d/dg of prior * mean sig(g)
        d_unl_minus = su * (1 - su) / len(unl)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            g = grad(pr, pc, pv, d_pos_plus - d_pos_minus) + grad(ur, uc, uv, d_unl_minus)
        else:  # step against the negative part, which has over-fitted
            g = -(grad(ur, uc, uv, d_unl_minus) - grad(pr, pc, pv, d_pos_minus))
        g[:-1] += L2 * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _fit(frame: pd.DataFrame, prior: float) -> pd.DataFrame:
    w = fit_nnpu(frame[frame["y"] == 1], frame[frame["y"] == -1], prior)
    return pd.DataFrame({"weights": [w.tolist()]})


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and prior learnt from the learnable rows only (texts, and quality of labelled ones)."""
    spark = docs.sparkSession
    learn = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    marks = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    prior = marks.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
    prior = float(prior) if prior is not None else 0.5
    order = F.xxhash64("doc_id")
    good = marks.where("quality = 1").select("doc_id").distinct()
    pos_ids = good.orderBy(order, "doc_id").limit(MAX_POSITIVES)
    unl_ids = learn.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    pos = learn.join(pos_ids, "doc_id", "left_semi").withColumn("y", F.lit(1))
    unl = learn.join(unl_ids, "doc_id", "left_semi").withColumn("y", F.lit(-1))
    ship(spark)
    sample = pos.unionByName(unl).mapInPandas(_featurise, "doc_id long, y int, idx array<long>, val array<double>")
    # One bounded group (at most MAX_POSITIVES + MAX_UNLABELLED rows) is fitted in one task.
    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        lambda f: _fit(f, prior), "weights array<double>"
    ).first()
    return (np.array(fitted["weights"]) if fitted else np.zeros(DIM + 1)), prior


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (sigmoid of the model's margin, 0 to 1) of every document, in Arrow batches."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)

    def score(batches):
        w = shared.value
        for b in batches:
            out = []
            for t in b["text"]:
                idx, val = features(t if isinstance(t, str) else None)
                out.append(1 / (1 + math.exp(-float(np.dot(w[idx], val) + w[-1]))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": out})

    ship(spark)
    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document for quality as ``labels.quality`` marks it.

    Returns doc_id, held_out (crc32 of doc_id as text is 0 mod 5; null id: true), score (0 to 1, higher:
    quality 1 likelier), predicted (1 where score >= 0.3). Labels, lang, source and doc_id never enter a
    score; only learnable rows teach. Null and empty texts get the score of an empty document; repeated rows
    are scored each; columns beyond doc_id and text are not read; an empty table gives no rows, and without
    positives or unlabelled rows the model is flat (score 0.5).
    """
    weights, _ = model(docs, labels)
    scored = scores(docs, weights)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
