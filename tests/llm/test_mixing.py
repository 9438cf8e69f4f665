from deckloom.llm import mixing


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r["source"], []).append(r)
    return out


def test_targets_and_cuts(spark):
    sizes = {"a": [10] * 6, "b": [100] * 5, "c": [7, 0, 300], "d": [1], None: [40, 2]}
    rows = [(n, " ".join("w" * s), src) for n, (src, s) in enumerate((k, x) for k, own in sizes.items() for x in own)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    own = by_source(got)
    total = sum(map(sum, sizes.values()))
    # a takes twice its 60; d twice its 1; the rest shares what is left 2:1:2 up to twice each
    assert own["a"][0]["target"] == 120 and own["d"][0]["target"] == 2
    assert abs(sum(x[0]["target"] for x in own.values()) - 1.5 * total) < 1e-6
    for source, x in own.items():
        assert sum(r["taken"] for r in x) == int(x[0]["target"])
        assert x[0]["source_size"] == sum(sizes[source])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in x)


def test_reruns_and_row_order_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix_sources(docs.orderBy("text").repartition(7)).collect()))


def test_odd_rows(spark, odd_documents, no_documents):
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (2, 3, 4))
    assert mixing.mix_sources(no_documents).count() == 0
    kept = mixing.mixed_documents(odd_documents)
    assert kept.schema.names == odd_documents.schema.names
    assert not {2, 3, 4} & {r["doc_id"] for r in kept.collect()}
    empty = odd_documents.where("doc_id IN (2, 3)")
    assert {r["taken"] for r in mixing.mix_sources(empty).collect()} == {0}
