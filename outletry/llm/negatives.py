"""Hard negatives for anchors, found by angular triangle filtering before exact integer scoring.

Every row stores its norm and its angles to ``REFERENCES`` fixed random directions. For an anchor ``a`` and a
row ``x`` the triangle inequality on the sphere bounds their angle by ``|ta - tx| <= t <= min(ta + tx,
2 pi - ta - tx)`` for each direction; the tightest cosine interval over all directions, times both norms and
widened by a rounding margin, bounds the integer score. Only pairs whose bounds overlap a window that can
matter (the running fifth-best positive, or a negative window of a positive) are scored exactly.

Anchors and rows meet in bounded pieces: anchors are dealt into blocks of ``ANCHOR_BLOCK`` and rows into
chunks of about ``ROW_CHUNK``, and each (block, chunk) pair is one cogroup. Each piece keeps its local top
rows; a window over at most (chunks x k) rows per anchor gives the global ones. The work is all anchors
against all rows, as the task states, and grows with both; no group grows with a hot label or vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletry.llm.shipping import ship
from outletry.session import stage

#: Fixed values of the task: scale of components, anchors, label shift, list sizes and the window in percent.
SCALE = 256
ANCHOR_EVERY = 50
SHIFT_EVERY = 7
POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
#: Method parameters.
REFERENCES = 8
SEED = 20240611
ANCHOR_BLOCK = 256
ROW_CHUNK = 4096

_PREPARED = "vec_id long, label int, ivec array<long>, norm double, angles array<double>"
_POSITIVE = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _directions(d: int) -> np.ndarray:
    rng = np.random.default_rng(SEED + d)
    u = rng.standard_normal((REFERENCES, d))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _matrix(vectors) -> np.ndarray:
    d = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), d), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _angles(ints: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles to the reference directions of ``d`` dimensions, the most of any row of the table, so that
    all batches measure against the same ones; a zero vector gets right angles (its norm is 0)."""
    x = ints.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    if x.shape[1] == 0:
        return norm, np.full((len(x), REFERENCES), math.pi / 2)
    cos = (x @ _directions(d)[:, : x.shape[1]].T) / np.where(norm > 0, norm, 1.0)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1.0, 1.0)), math.pi / 2)


def _prepare(batches, d: int):
    for b in batches:
        ints = _matrix(list(b["ivec"]))
        norm, ang = _angles(ints, d)
        yield pd.DataFrame(
            {"vec_id": b["vec_id"], "label": b["label"], "ivec": b["ivec"], "norm": norm, "angles": list(ang)}
        )


def prepared(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: label shifted, components scaled to integers, norm and angles stored.

    A row with a null vec_id, label or vector, or a null or non-finite component, is left out. Of rows
    sharing a vec_id, the one with the smallest (label, scaled vector) takes part. Vectors of different
    lengths count missing components as 0.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & F.col("vec_id").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("ivec"),
    )
    # vec_id names a row: of rows sharing one, the smallest (label, vector) takes part.
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "ivec")).alias("m")).select("vec_id", "m.label", "m.ivec")
    ship(embeddings.sparkSession)
    d = embeddings.agg(F.max(F.size(x))).first()[0] or 0
    return rows.mapInPandas(lambda batches: _prepare(batches, d), _PREPARED)


def _bounds(a: pd.DataFrame, x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every anchor-row score (anchors by rows), widened for rounding."""
    ta, tx = np.stack(a["angles"].to_numpy()), np.stack(x["angles"].to_numpy())
    na, nx = a["norm"].to_numpy(), x["norm"].to_numpy()
    lo_cos = np.full((len(ta), len(tx)), -1.0)
    hi_cos = np.full((len(ta), len(tx)), 1.0)
    for r in range(ta.shape[1]):
        s = ta[:, r, None] + tx[None, :, r]
        lo_cos = np.maximum(lo_cos, np.cos(np.minimum(s, 2 * math.pi - s)))
        hi_cos = np.minimum(hi_cos, np.cos(np.abs(ta[:, r, None] - tx[None, :, r])))
    scale = na[:, None] * nx[None, :]
    margin = 1e-6 * scale + 1.0
    return scale * lo_cos - margin, scale * hi_cos + margin


def _exact(a_int: np.ndarray, x_int: np.ndarray, ai: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Exact scores, as Python integers where any of the products could pass 64 bits."""
    d = max(a_int.shape[1], x_int.shape[1])
    a_int = np.pad(a_int, ((0, 0), (0, d - a_int.shape[1])))
    x_int = np.pad(x_int, ((0, 0), (0, d - x_int.shape[1])))
    most = float(d) * np.abs(a_int.astype(np.float64)).max(initial=0) * np.abs(x_int.astype(np.float64)).max(initial=0)
    if most < 2.0**62:
        return np.einsum("ij,ij->i", a_int[ai], x_int[xi])
    pairs = zip(a_int[ai].tolist(), x_int[xi].tolist(), strict=True)
    return np.array([sum(p * q for p, q in zip(a, x, strict=True)) for a, x in pairs], dtype=object)


def _window(positive: int) -> tuple[int, int]:
    """Lowest and highest score of a negative. Python integers: percents of a 64-bit score may pass 64 bits."""
    return -(-LOW_PERCENT * positive // 100), HIGH_PERCENT * positive // 100


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by score descending, then id ascending."""
    return np.lexsort((ids, -scores))[:k]


def _empty(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})


def _local_positives(x: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(x) and len(a):
        lo, hi = _bounds(a, x)
        a_int, x_int = _matrix(list(a["ivec"])), _matrix(list(x["ivec"]))
        xid, xlab = x["vec_id"].to_numpy(), x["label"].to_numpy()
        for i, (aid, alab) in enumerate(zip(a["vec_id"].to_numpy(), a["label"].to_numpy(), strict=True)):
            same = np.flatnonzero((xlab == alab) & (xid != aid))
            if not len(same):
                continue
            floor_ = np.sort(lo[i, same])[-POSITIVES] if len(same) >= POSITIVES else -np.inf
            cand = same[hi[i, same] >= floor_]
            s = _exact(a_int, x_int, np.full(len(cand), i), cand)
            keep = _top(xid[cand], s, POSITIVES)
            out.append(pd.DataFrame({"anchor_id": aid, "positive_id": xid[cand][keep], "positive_score": s[keep]}))
    return pd.concat(out, ignore_index=True) if out else _empty("anchor_id", "positive_id", "positive_score")


def _local_negatives(x: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(x) and len(a):
        lo, hi = _bounds(a, x)
        a_int, x_int = _matrix(list(a["ivec"])), _matrix(list(x["ivec"]))
        xid, xlab = x["vec_id"].to_numpy(), x["label"].to_numpy()
        for i, row in enumerate(a.itertuples(index=False)):
            ps = np.asarray(row.ps, dtype=np.int64)
            other = np.flatnonzero(xlab != row.label)
            if not len(other) or not len(ps):
                continue
            # Windows on the score: LOW% to HIGH% of each positive's score; empty where the score is negative.
            windows = [_window(p) for p in ps.tolist()]
            live = [(l_, h_) for l_, h_ in windows if l_ <= h_]
            if not live:
                continue
            meets = np.zeros(len(other), dtype=bool)
            for l_, h_ in live:
                meets |= (hi[i, other] >= float(l_)) & (lo[i, other] <= float(h_))
            cand = other[meets]
            s = _exact(a_int, x_int, np.full(len(cand), i), cand)
            for pid, p, (l_, h_) in zip(row.pids, ps, windows, strict=True):
                ok = ((l_ <= s) & (s <= h_)).astype(bool)
                keep = _top(xid[cand][ok], s[ok], NEGATIVES)
                out.append(
                    pd.DataFrame(
                        {
                            "anchor_id": row.vec_id, "positive_id": pid, "positive_score": p,
                            "negative_id": xid[cand][ok][keep], "negative_score": s[ok][keep],
                        }
                    )
                )
    cols = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
    return pd.concat(out, ignore_index=True) if out else _empty(*cols)


def _pieces(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows replicated to every anchor block and anchors to every row chunk, keyed by (block, chunk)."""
    chunks = max(1, math.ceil(rows.count() / ROW_CHUNK))
    blocks = max(1, math.ceil(anchors.count() / ANCHOR_BLOCK))
    r = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    a = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )
    return r, a


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """For each anchor and each of its positives, the first hard negatives.

    Anchors are rows whose vec_id is divisible by 50; an anchor's positives are its first 5 other rows of the
    same label by integer score (higher first, ties by smaller vec_id), all if fewer. Negatives are rows of
    another label whose score lies in [50 %, 95 %] of the positive's score, the first 3 in the same order.
    Returns anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score. Rows
    left out (null or non-finite) take no part; an empty table, or anchors without positives, give no rows;
    of rows sharing a vec_id one takes part (see ``prepared``); columns beyond vec_id, embedding and label are not read.
    """
    rows = stage(prepared(embeddings.select("vec_id", "embedding", "label")), "vectors")
    # Fresh names, so that anchors and rows are two sides of the cogroups, not one table met with itself.
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select([F.col(c).alias(c) for c in rows.columns])
    r, a = _pieces(rows, anchors)
    local = r.groupBy("block", "chunk").cogroup(a.groupBy("block", "chunk")).applyInPandas(
        lambda x, y: _local_positives(x, y), _POSITIVE
    )
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = stage(local.withColumn("n", F.row_number().over(first)).where(f"n <= {POSITIVES}").drop("n"), "positives")
    lists = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("p")
    )  # at most POSITIVES entries each
    armed = anchors.join(lists, "vec_id").select(
        "vec_id", "label", "ivec", "norm", "angles",
        F.col("p.positive_id").alias("pids"), F.col("p.positive_score").alias("ps"),
    )
    r, a = _pieces(rows, armed)
    found = r.groupBy("block", "chunk").cogroup(a.groupBy("block", "chunk")).applyInPandas(
        lambda x, y: _local_negatives(x, y), _NEGATIVE
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {NEGATIVES}").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
