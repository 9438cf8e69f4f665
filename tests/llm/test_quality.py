import zlib

import numpy as np
import pyarrow as pa

from deckloom.llm import quality
from deckloom.llm.queries import op1_quality, table


def test_pairwise_identity_against_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.3, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, 4)))
    index, values = np.array([3, 8, 11, 5, 3]), rng.normal(size=5)
    got = m.score(index, values, np.array([3, 2]))
    for row, (x, y) in enumerate([(0, 3), (3, 5)]):
        i, v = index[x:y], values[x:y]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(got[row], 1 / (1 + np.exp(-(0.3 + m.linear[i] @ v + pairs))))


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = op1_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (1, 0), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd_documents, labels)
    rows = quality.score_quality(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    kept = quality.keep_quality(odd_documents, model, threshold=0.0)
    assert kept.schema == odd_documents.schema and kept.count() == odd_documents.count()
    assert quality.score_quality(no_documents, model).count() == 0
    untaught = quality.fit_quality(no_documents, labels.limit(0))
    assert abs(untaught.score(*quality.features(pa.array(["a b"]), None))[0] - 0.5) < 0.2
