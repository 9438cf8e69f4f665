import random

import numpy as np
import pytest

from deckloom.llm import graph
from deckloom.llm.neardup import NearDuplicates, drop_near_duplicates, near_duplicates
from deckloom.llm.queries import table
from deckloom.llm.text import mix


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(seed, sizes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = {}
    for n in sizes:
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(120)] = rng.choice(words)
            texts[len(texts)] = " ".join(own)
    return texts


def long_families(seed, sizes, words=3000):
    """Copies of long texts, each with about one word in 80 changed."""
    rng, texts = random.Random(seed), {}
    for n in sizes:
        base = [f"v{rng.randrange(50_000)}" for _ in range(words)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, words // 40)):
                own[rng.randrange(words)] = f"v{rng.randrange(50_000)}"
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize("settings", [NearDuplicates(), NearDuplicates(node=8, rounds=2), NearDuplicates(shingles=20_000, rounds=2)])
def test_long_texts_against_brute_force(spark, settings):
    texts = long_families(5, (12, 9, 5, *[1] * 10))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame, settings=settings).collect()}
    assert got == brute(texts)


def test_deeper_branches_split_long_sets():
    """Unrelated sets of 3,000 shingles part at once; similar ones stay."""
    s, rng = NearDuplicates(), np.random.default_rng(1)
    sets = np.sort(rng.integers(0, 2**63, (200, 3000), np.uint64), axis=1)
    sets[1::2] = np.sort(np.concatenate([sets[::2, :2800], rng.integers(0, 2**63, (100, 200), np.uint64)], axis=1), axis=1)
    short = mix(s.signatures(sets.ravel(), np.full(200, 3000))).astype(np.uint8)
    row, path = s.paths(short, np.zeros(200, np.uint64), 1)
    nodes = {}
    for r, p in zip(row.tolist(), path.tolist(), strict=True):
        nodes.setdefault(p, set()).add(r)
    assert max(len({r // 2 for r in own}) for own in nodes.values()) <= 4
    assert sum(any({2 * i, 2 * i + 1} <= own for own in nodes.values()) for i in range(100)) >= 99


@pytest.mark.parametrize("settings", [NearDuplicates(), NearDuplicates(node=24, rounds=1), NearDuplicates(node=4, rounds=0)])
def test_components_against_brute_force(spark, settings):
    texts = families(3, (60, 30, 4, 2, 1))
    texts |= {len(texts) + i: t for i, t in enumerate(["", None, "a b", "A  b\n", "a a a a", "a a a a a a", "a"])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame, settings=settings).collect()}
    assert got == brute(texts)


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()} == want


def test_odd_rows(spark, odd_documents, no_documents):
    rows = near_duplicates(odd_documents).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_documents.count()
    assert by[6]["component_id"] == 1 and not by[6]["kept"]
    assert all(by[i]["component_id"] == i and by[i]["kept"] and by[i]["n_shingles"] == 0 for i in (2, 3, 4))
    assert near_duplicates(no_documents).count() == 0
    kept = drop_near_duplicates(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 8, None]))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 299)]
    for broadcast in (10_000, 0):
        got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long"), broadcast_labels=broadcast).collect()))
        assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[300] == 299
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_trees_reach_the_recall():
    assert 1 - (1 - NearDuplicates()._survival()) ** NearDuplicates().trees >= 0.9999


def test_one_row_of_each_component_stays(spark):
    """Null ids, ids of several texts and repeated rows included."""
    texts = families(9, (5, 4, 3))
    rows = [(None if i < 5 else 7 if i < 9 else i, t) for i, t in texts.items()]
    rows += rows[5:7] + [(50, "x"), (50, "x"), (50, "other words"), (None, None), (None, "")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    component = {shingles(texts[i]): c for i, (_, c) in brute(texts).items()}
    found = [component.get(shingles(r["text"]), r["text"]) for r in kept]
    assert sorted(map(str, found)) == sorted(map(str, [*set(component.values()), "x", "other words", None, ""]))
