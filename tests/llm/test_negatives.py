"""Hard negatives by angular bounds against a brute force over all anchor-row pairs."""

import math
import random

import pytest

from outletry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, rank double"


def brute(rows):
    valid = []
    for vid, emb, label, *_ in rows:
        if vid is None or label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        label = (label + 1) % 10 if vid % 7 == 0 else label
        valid.append((vid, label, [math.floor(256 * float(x)) for x in emb]))
    valid = sorted({v[0]: v for v in sorted(valid, key=lambda v: (v[0], v[1], v[2]), reverse=True)}.values())
    out = []
    for aid, alab, av in valid:
        if aid % 50:
            continue
        scored = [(vid, lab, sum(p * q for p, q in zip(av, v))) for vid, lab, v in valid if vid != aid]
        same = sorted((s for s in scored if s[1] == alab), key=lambda s: (-s[2], s[0]))[:5]
        for pid, _, ps in same:
            neg = sorted((s for s in scored if s[1] != alab and 50 * ps <= 100 * s[2] <= 95 * ps), key=lambda s: (-s[2], s[0]))[:3]
            out += [(aid, pid, k + 1, nid, ps, ns) for k, (nid, _, ns) in enumerate(neg)]
    return sorted(out)


def vectors(n, d, seed, labels=3):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(labels)]
    rows = []
    for i in range(n):
        lab = rng.randrange(labels)
        v = [(b + rng.gauss(0, 0.7)) / math.sqrt(d) for b in base[lab]]
        rows.append((i, v, lab, "x", 1.0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_CHUNK", 64)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    rows = vectors(400, 16, seed)
    rows += [(1000, [0.1] * 16, 1, "x", 1.0), (1050, [0.1] * 16, 1, "x", 1.0), (1100, [0.1] * 16, 2, "x", 1.0)]  # ties
    rows += [(1150, None, 1, "x", 1.0), (1200, [0.1] * 16, None, "x", 1.0), (1250, [float("nan")] + [0.1] * 15, 1, "x", 1.0)]
    rows += [(1300, [float("inf")] + [0.1] * 15, 1, "x", 1.0), (1350, [None] + [0.1] * 15, 1, "x", 1.0)]
    rows += [(1400, [0.0] * 16, 1, "x", 1.0), (300, rows[300][1], rows[300][2], "x", 1.0), (250, [0.2] * 16, 9, "x", 1.0)]  # zero vector, repeated ids
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df).collect())
    assert got == brute(rows)
    assert got


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_of_scores_near_64_bits(spark):
    """Scores fit 64 bits here, 50 and 95 times them do not."""
    rows = [(i, [float(round(x * 4e6)) for x in v], lab, "x", 1.0) for i, v, lab, *_ in vectors(160, 8, 3)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    want = brute(rows)
    assert max(r[4] for r in want) > 2**63 // 95
    assert got == want


def test_windows_when_one_row_is_longer(spark):
    """All rows must be measured against the same directions, also if a batch holds a longer vector."""
    rows = [(i, v, lab, "x", 1.0) for i, v, lab, *_ in vectors(300, 3, 4)]
    rows += [(400 + i, [0.0, 0.1, 0.1, 0.01], i % 3, "x", 1.0) for i in range(2)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "16")
    try:
        got = sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    finally:
        spark.conf.set(size, before)
    assert got == brute(rows)
