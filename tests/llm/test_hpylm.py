import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from deckloom.llm import hpylm
from deckloom.llm.queries import table
from deckloom.llm.text import word_hashes

SMALL = hpylm.PitmanYor(block_tokens=3000, least_shards=5, picked=1)


def test_base_and_gain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r for r in hpylm.score_texts(docs, model=SMALL).collect()}
    texts = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), None] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, own in texts.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in texts.items():
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (rows[i]["held_out"], rows[i]["n_tokens"], rows[i]["train_tokens"]) == (held[i], len(own), n)
        assert rows[i]["n_known"] == sum(counts[w] > 0 for w in own)
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9)
    for flag in (True, False):
        own = [r for r in rows.values() if r["held_out"] is flag]
        assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def _hash(word):
    return int(word_hashes(pa.array([word]))[0][0])


def test_scores_against_a_plain_model(spark, monkeypatch):
    """From the sampled seatings alone, by the formulas of the process in plain
    Python: customers are the counts of pairs, tables lie within them, scores
    are the averaged probabilities, and these sum to one."""
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(words, rng.integers(0, 7), p=(w := 1 / np.arange(1, 41)) / w.sum())) for _ in range(300)]
    texts += ["never seen", "w0 never", ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    kept = {}

    def capture(states, told, requests, model, totals, split, answer=hpylm._answers):
        kept.setdefault("states", []).extend(states.collect())
        kept.setdefault("told", []).extend(told.where("shard >= 0").collect())
        kept["split"] = split
        return answer(states, told, requests, model, totals, split)

    monkeypatch.setattr(hpylm, "_answers", capture)
    got = {r["doc_id"]: r for r in hpylm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), model=SMALL).collect()}
    m, n = SMALL, SMALL.samples
    assert len(kept["split"].hashes) > 0  # frequent contexts are dealt over shards
    seats, parent = {}, {}
    for row in kept["states"]:
        seated = hpylm._Seating.of(row["body"])
        for pair, (u, w) in enumerate(zip(seated.contexts[seated.owner].tolist(), seated.words[seated.word].tolist(), strict=True)):
            assert (u, w) not in seats  # no pair is in two shards
            seats[u, w] = seated.customers[pair], seated.all_samples(n)[:, pair]
        told = sorted((r for r in kept["told"] if r["shard"] == row["shard"]), key=lambda r: r["parent"])
        own = [np.stack([x.reshape(n, -1) for x in hpylm._unpack(r["body"], np.int32, np.int32)]) for r in told]
        for w, x in zip(seated.words.tolist(), np.concatenate(own, axis=2).transpose(2, 0, 1), strict=True):
            assert w not in parent or np.array_equal(parent[w], x)
            parent[w] = x
    end, start, cut = int(hpylm.END), int(hpylm.START), 16
    chains = {i: [start, *[_hash(w) for w in t.split()], end] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter((u, w >> cut) for i, c in chains.items() if not held[i] for u, w in zip(c, c[1:], strict=False))
    assert {k: int(c) for k, (c, _) in seats.items() if c} == dict(counts)
    assert all((t >= min(c, 1)).all() and (t <= c).all() for c, t in seats.values())
    known = {w for _, w in counts}
    served = {w: sum((t for (_, x), (_, t) in seats.items() if x == w), np.zeros(n, int)) for w in parent}
    assert all(np.array_equal(parent[w][0], served[w]) for w in parent)
    assert all((parent[w][1] >= np.minimum(served[w], 1)).all() and (parent[w][1] <= served[w]).all() for w in parent)
    tables0 = sum(parent[w][1] for w in known)
    all_served, v = sum(served[w] for w in known), len(known)

    def chance(u, w):
        c_u = sum(c for (x, _), c in counts.items() if x == u)
        t_u = sum((t for (x, y), (_, t) in seats.items() if x == u), np.zeros(n, int))
        s_w, t_w = parent[w] if w in known else (np.zeros(n), np.zeros(n))
        up = (s_w - m.parent_discount * t_w + (m.parent_strength + m.parent_discount * tables0) / (v + 1)) / (m.parent_strength + all_served)
        c, t = seats.get((u, w), (0, np.zeros(n)))
        return float(np.mean((c - m.discount * t + (m.strength + m.discount * t_u) * up) / (m.strength + c_u)))

    for i, c in chains.items():
        want = sum(math.log10(chance(u, w >> cut)) for u, w in zip(c, c[1:], strict=False))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-5, abs_tol=1e-5)
    for u in (start, _hash("w0"), _hash("w39"), _hash("never")):
        assert abs(sum(chance(u, w) for w in known) + chance(u, -1) - 1) < 1e-9


def test_stirling_ratio_by_enumeration():
    """One of three customers at two tables sits alone in one of three
    partitions, weighed by (1 - d)."""
    s = hpylm._Stirling(0.5, 8)
    assert np.isclose(s.alone(np.array([2]), np.array([2]))[0], 1)
    assert np.isclose(s.alone(np.array([2]), np.array([1]))[0], 0)
    assert np.isclose(s.alone(np.array([3]), np.array([2]))[0], 1 / 3)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = hpylm.score_texts(odd_documents, model=SMALL).collect()
    assert len(rows) == odd_documents.count()
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    assert next(r for r in rows if r["doc_id"] == 5)["n_tokens"] == 60_002
    assert hpylm.score_texts(no_documents, model=SMALL).count() == 0
    untaught = odd_documents.where(hpylm.held_out("doc_id"))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in hpylm.score_texts(untaught, model=SMALL).collect())


def test_reruns_agree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one, two = ({r["doc_id"]: r["score"] for r in hpylm.score_texts(d, model=SMALL).collect()} for d in (docs, docs))
    assert one == two


def test_ratio_of_many_customers():
    exact, far = hpylm._Stirling(0.85, 400), hpylm._Stirling(0.85, 100)
    tables = np.array([1, 2, 5, 40, 150, 300, 390, 399])
    for c in (200, 400):
        t = tables[tables <= c]
        assert np.allclose(far.alone(np.full(len(t), c), t), exact.alone(np.full(len(t), c), t), rtol=0.05)


def test_sweep_reseats_every_customer():
    """One sweep leads from any seating to the exact distribution of tables,
    however many customers a dish has."""
    rng, n = np.random.default_rng(2), 4000
    stirling, exact = hpylm._Stirling(0.85), hpylm._Stirling(0.85, 1000)
    for c in (2, 20, 128, 129, 300, 1000):
        t = np.arange(1, c + 1)
        for w in (0.01, 1.5, 30.0, 1000.0):
            log = exact.log[c, 1 : c + 1] + np.log(w) * t
            p = np.exp(log - log.max())
            p /= p.sum()
            mean, spread = p @ t, math.sqrt(max(0, p @ t**2 - (p @ t) ** 2))
            for start in (1, c):
                got = hpylm._sweep(np.full(n, c), np.full(n, start, np.int64), np.full(n, w), stirling, rng)
                assert abs(got.mean() - mean) <= 0.03 * mean + 4 * spread / math.sqrt(n), (c, w, start, mean, got.mean())
                assert abs(got.std() - spread) <= 0.1 * spread + 0.05, (c, w, start, spread, got.std())
