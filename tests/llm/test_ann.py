import numpy as np
from pyspark.sql import functions as F

from deckloom.llm import ann
from deckloom.llm.queries import table

MANY_CELLS = ann.Projections(block=40, queries=3, most_cells=8)


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in queries:
        score = unit @ unit[ids == q][0]
        near = sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)[:k]
        out[q] = [i for _, i in near]
    return out


def found(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    return {q: [own[i] for i in sorted(own)] for q, own in out.items()}


def test_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    want = brute([(r["vec_id"], r["embedding"]) for r in rows.collect()], range(0, 500, 50), 5)
    for model in (None, MANY_CELLS):
        got = found(ann.nearest(rows, F.col("vec_id") % 50 == 0, model=model))
        assert got.keys() == want.keys()
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(100, 140)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0]) for i in range(30)]  # a group of copies
    rows += [(200, [1.0, 2.0, 0.0, 0.0]), (200, [1.0, 2.0, 0.0, 0.0])]
    odd = [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 1.0, 0.0, 0.0]), (304, [float("inf")] * 4), (350, [1.0, 2.0]), (None, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, 1, "s") for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score string")
    got = found(ann.nearest(frame, F.col("vec_id") % 50 == 0, model=MANY_CELLS))
    assert got.keys() == {0, 100, 200}
    assert got[0] == [1, 2, 3, 4, 5] and got[200] == [0, 1, 2, 3, 4]


def test_few_or_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert found(ann.nearest(frame, F.col("vec_id") % 50 == 0)) == {0: [1]}
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(frame.limit(1), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(ann.Projections(directions=12, confidence=0.95).limit() - 21.026) < 0.01
