import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deckloom.llm.queries import table

#: Names that operators use inside, as columns of the input.
NAMES = (
    "host", "declared", "likelihood", "own", "joint", "confidence", "claim", "domain", "suffix", "language", "accepted", "known", "n_trigrams",
    "digest", "words", "row", "id", "rep", "label", "paths", "short", "size", "n_shingles", "component_id", "kept", "whole", "key", "part", "src",
    "source_size", "target", "taken", "level", "rank", "weight", "__id", "__digest", "__text", "__words", "__times", "__copy", "__label",
    "held_out", "score", "predicted", "grp", "turn", "spread", "piece", "start", "length", "__source", "__size",
)


def _values(rows, names):
    return sorted(repr(tuple(r[c] for c in names)) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_names_odd_rows_and_empty_tables(spark, sf_dir, odd_documents, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = table(spark, sf_dir, "documents")
    plain = plain.limit(60).unionByName(odd_documents.select(*plain.columns))
    extra = plain.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(NAMES)])
    want, got = stage(spark, plain, sf_dir).collect(), stage(spark, extra, sf_dir).collect()
    if name == "packing":
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert {r["doc_id"] for r in got} == {r["doc_id"] for r in extra.collect()}
    else:
        names = plain.columns
        assert all(r[c] == f"x{i}" for r in got for i, c in enumerate(NAMES))
        assert stage(spark, extra, sf_dir).columns == extra.columns
    assert _values(want, names) == _values(got, names) and got
    assert stage(spark, extra.limit(0), sf_dir).collect() == []


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == names
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    good = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in docs.collect()}
    assert len(good & kept) > 0.8 * len(good)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        assert sum(n for _, n in own) == max(o + n for o, n in own) <= 1024
