"""Language-model scores from a hierarchical Pitman-Yor process.

Every word is a context: a restaurant whose customers are the tokens that
follow it and whose dishes are words; a text's start is one more.  All context
restaurants share one parent, whose customers are their tables and whose base
is uniform over the known words and one unknown.  Seating is sampled by Gibbs,
every customer in every sweep.  A dish's state is its customers and its tables;
its tables given all else have a distribution of generalised Stirling numbers,
from which all its customers are reseated at once: exactly in dishes of up to
128 customers, by a fitted binomial in larger ones.  Scores use predictive
probabilities averaged over samples of the whole seating, and every sample's
probabilities sum to one.

Spread over a cluster, the hierarchy is two sets of shards.  Context shards
hold restaurants, by a hash of the context; those too frequent for one shard are
split by their dishes.  Parent shards hold the parent's dishes, by ranges of the
word's hash.  In each round context shards send their tables of each word up,
parent shards seat them and send the parent's counts of each word down, in the
order asked, and the context shards are swept.  What the driver holds is a few
totals, and the tables of split restaurants, whose number is bounded.

Texts are read once, into blocks of a bounded number of tokens.  A block asks
each context shard for its distinct pairs of context and word, packed in one
message; the answers are joined back to the block.  Messages number at most the
distinct words of a block, and shards grow in number with the input, so no task
holds more than a shard or a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.store import discard, materialise
from deckloom.llm.text import mix, text_slices, word_hashes

#: The hashes of a text's end, a token, and of its start, a context; no word
#: has them, up to a collision.
END, START = np.uint64(0xE0D0_F7E0_7000_0001), np.uint64(0x57A2_7000_0000_0001)


@dataclass(frozen=True)
class PitmanYor:
    discount: float = 0.85
    strength: float = 2.0
    parent_discount: float = 0.8
    parent_strength: float = 2.0
    burn_in: int = 2  # rounds; the parent's counts are exchanged in each
    samples: int = 2  # one a round, after those of burn-in
    sweeps: int = 2  # a round
    block_tokens: int = 400_000
    shard_bytes: int = 4 << 20  # of input, to a context shard
    least_shards: int = 16
    passes: int = 2  # over the blocks for answers: each moves that share of what they ask
    picked: int = 16  # one text of so many is counted to find contexts to split
    split: int = 20_000  # most contexts that are split
    seed: int = 3


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed body: their lengths, then their bytes, all
    first bytes of an array's values before all second ones."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *planes]))


def _unpack(body, *types) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def _six(words: np.ndarray) -> np.ndarray:
    """The 48 bits that name a word inside messages, as six planes of bytes."""
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :6].T).ravel()


def _of_six(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(planes) // 6, 8), np.uint8)
    out[:, :6] = planes.reshape(6, -1).T
    return out.view(np.uint64).reshape(-1)


def _range_of(hashes: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Which of n equal ranges of the top 32 of ``bits`` bits."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _present(shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards in an ascending array, and their places."""
    which, first = np.unique(shards, return_index=True)
    for shard, x, y in zip(which.tolist(), first.tolist(), [*first[1:].tolist(), len(shards)], strict=True):
        yield shard, slice(x, y)


@dataclass(frozen=True)
class _Split:
    """Contexts dealt over several shards by their dishes: hashes, ascending,
    and into how many parts; then, as known, their customers and, for each
    sample, their tables."""

    hashes: np.ndarray
    parts: np.ndarray
    customers: np.ndarray
    tables: np.ndarray

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts here, and which of them are."""
        if not len(self.hashes):
            return np.zeros(len(contexts), np.int64), np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.hashes, contexts), len(self.hashes) - 1)
        return at, self.hashes[at] == contexts

    def shard_of(self, contexts: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        at, hot = self.find(contexts)
        keys = mix(contexts)
        if hot.any():
            keys[hot] = mix(keys[hot] + mix(words[hot]) % self.parts[at[hot]] + np.uint64(1))
        return _range_of(keys, 64, n)


_BLOCK_TYPES = (np.int64, np.uint8, np.uint8, np.int64, np.uint64, np.int32)  # ids, null ids, held out, tokens; vocabulary, words


class _Block:
    """A block of texts, and its distinct pairs in the order of their shards."""

    def __init__(self, body, split: _Split, n_shards: int):
        self.ids, self.empty_id, self.held, self.lengths, vocabulary, words = _unpack(body, *_BLOCK_TYPES)
        n, v = int(self.lengths.sum()), len(vocabulary)
        ends = np.cumsum(self.lengths)
        self.is_end = np.zeros(n, bool)
        self.is_end[ends - 1] = True
        word = np.full(n, v, np.int64)
        word[~self.is_end] = words
        context = np.empty(n, np.int64)
        context[1:] = word[:-1]
        context[ends - self.lengths] = v
        pairs, pair = np.unique(context * (v + 1) + word, return_inverse=True)
        contexts, dishes = np.append(vocabulary, START)[pairs // (v + 1)], np.append(vocabulary, END)[pairs % (v + 1)]
        shards = split.shard_of(contexts, dishes, n_shards)
        order = np.argsort(shards, kind="stable")
        self.contexts, self.words, self.shards = contexts[order], dishes[order] >> np.uint64(16), shards[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair = place[pair]

    def requests(self, number: int, wanted: range) -> Iterator[tuple[int, int, bytes]]:
        learns = np.repeat(self.held == 0, self.lengths)
        seen = np.bincount(self.pair[learns], minlength=len(self.shards)).astype(np.int32)
        for shard, p in _present(self.shards):
            if shard in wanted:
                yield shard, number, _pack(*_runs(self.contexts[p]), _six(self.words[p]), seen[p])


_REQUEST_TYPES = (np.uint64, np.uint32, np.uint8, np.int32)  # contexts, pairs of each; words, training counts


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal values: the value and the length of each."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values))).astype(np.uint32)


def _asked(body) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a request: context and word of each pair, and its training count."""
    contexts, per, words, seen = _unpack(body, *_REQUEST_TYPES)
    return np.repeat(contexts, per), _of_six(words), seen


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _batches(rows: Iterator[tuple], schema: str, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a body, in batches of about ``size`` bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n >= size:
            yield _rows(held, schema)
            held, n = [], 0
    if held:
        yield _rows(held, schema)


_BLOCK = "block long, body binary"
_MESSAGE = "shard int, block long, body binary"


def _to_blocks(docs: DataFrame, model: PitmanYor) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, size = TaskContext.get().partitionId() << 24, ([], [], [], []), 0

        def flush() -> pa.RecordBatch:
            ids, held, words, counts = (np.concatenate(x) for x in now)
            vocabulary, word = np.unique(words, return_inverse=True)
            empty = np.array([i is None for i in ids], np.uint8)
            numbers = np.array([0 if i is None else i for i in ids], np.int64)
            return _rows([(number, _pack(numbers, empty, held, counts + 1, vocabulary, word.astype(np.int32)))], _BLOCK)

        for part in text_slices(batches, 2):
            words, counts = word_hashes(part.column(2))
            ids = np.array([*part.column(0).to_pylist(), None], object)[:-1]
            for kept, new in zip(now, (ids, part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), words, counts), strict=True):
                kept.append(new)
            size += len(words) + len(counts)
            if size >= model.block_tokens:
                yield flush()
                number, now, size = number + 1, ([], [], [], []), 0
        if now[0]:
            yield flush()

    return docs.mapInArrow(run, _BLOCK)


def _requests(blocks: DataFrame, split: _Split, n_shards: int, wanted: range) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(_Block(body.as_buffer(), split, n_shards).requests(number, wanted), _MESSAGE)

    return blocks.mapInArrow(run, _MESSAGE)


def _frequent(docs: DataFrame, model: PitmanYor, n_shards: int) -> _Split:
    """Contexts that would fill more than half a shard, by their share of one
    text in ``picked``; this only decides where they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in text_slices(batches, 0):
            new, texts = word_hashes(part.column(0))
            of, n = np.unique(np.append(new, np.full(len(texts), START)), return_counts=True)
            words, at = np.unique(np.concatenate([words, of]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(words)).astype(np.int64)
        many = counts >= 2e-6 * counts.sum()
        rows = zip(words[many].view(np.int64).tolist(), counts[many].tolist(), strict=True)
        yield _rows([*rows, (0, int(counts[~many].sum()))], "word long, n long")

    some = docs.where(F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(model.picked)) == 0).select("text")
    counts = materialise(some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("word") != 0) & (2 * n_shards * F.col("n") > total)).orderBy(F.desc("n"), "word").limit(model.split).collect()
    discard(counts)
    hashes = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    parts = np.array([math.ceil(2 * n_shards * r["n"] / total) for r in rows], np.uint64)
    order = np.argsort(hashes)
    none = np.zeros(len(rows))
    return _Split(hashes[order], parts[order], none, none[None])


_STATE = "shard int, body binary"
_STATE_TYPES = (np.uint64, np.uint32, np.uint8, np.int32, np.int32, np.int32)


@dataclass
class _Seating:
    """A shard's restaurants: contexts, pairs of each, words, the word of each
    pair, its customers, and, for each sample, its tables.  Pairs that are
    only asked for have neither; one customer has one table, so only pairs of
    more customers store theirs."""

    contexts: np.ndarray
    per: np.ndarray
    words: np.ndarray
    word: np.ndarray
    customers: np.ndarray
    tables: np.ndarray

    def body(self) -> bytes:
        some = self.customers > 1
        return _pack(
            self.contexts, self.per.astype(np.uint32), _six(self.words), self.word.astype(np.int32), self.customers.astype(np.int32),
            self.tables[:, some].astype(np.int32).ravel(),
        )

    @classmethod
    def of(cls, body) -> _Seating:
        contexts, per, words, word, customers, tables = _unpack(body, *_STATE_TYPES)
        some = np.flatnonzero(customers > 1)
        samples = len(tables) // len(some) if len(some) else 1
        full = np.repeat(np.minimum(customers, 1)[None], samples, axis=0)
        full[:, some] = tables.reshape(samples, -1)
        return cls(contexts, per, _of_six(words), word.astype(np.int64), customers.astype(np.int64), full)

    def all_samples(self, n: int) -> np.ndarray:
        """Tables by sample; a shard without choices has one for all."""
        return self.tables if len(self.tables) == n else np.repeat(self.tables[:1], n, axis=0)

    @property
    def owner(self) -> np.ndarray:
        """The context of each pair."""
        return np.repeat(np.arange(len(self.contexts)), self.per)


def _first_seating(requests: DataFrame) -> DataFrame:
    """One row a context shard: all pairs that are asked for, their customers,
    and a first seating, one table to each pair that has any."""

    def run(group: pa.Table) -> pa.Table:
        contexts, words, seen = (np.concatenate(x) for x in zip(*[_asked(x.as_buffer()) for x in group["body"]], strict=True))
        contexts, context = np.unique(contexts, return_inverse=True)
        words, word = np.unique(words, return_inverse=True)
        pairs, at = np.unique(context * len(words) + word, return_inverse=True)
        customers = np.bincount(at, seen, len(pairs)).astype(np.int64)
        per = np.bincount(pairs // len(words), minlength=len(contexts))
        body = _Seating(contexts, per, words, pairs % len(words), customers, np.minimum(customers, 1)[None]).body()
        return pa.Table.from_batches([_rows([(group["shard"][0].as_py(), body)], _STATE)])

    return requests.groupBy("shard").applyInArrow(run, _STATE)


@dataclass(frozen=True)
class _Totals:
    """Training tokens, known words, and for each sample the parent's
    customers and tables."""

    tokens: int
    words: int
    served: tuple[float, ...]
    tables: tuple[float, ...]


def _corpus(states: DataFrame, split: _Split) -> tuple[_Totals, _Split]:
    """Tokens and words of the training rows, and the split contexts'
    customers and tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                seated = _Seating.of(body.as_buffer())
                own = np.bincount(seated.owner, seated.customers, len(seated.contexts)).astype(np.int64)
                at, hot = split.find(seated.contexts)
                rows = [(-1, int(own.sum())), (-2, int(((own > 0) & ~hot & (seated.contexts != START)).sum()))]
                rows += [(int(i), int(n)) for i, n in zip(at[hot], own[hot], strict=True)]
                yield _rows(rows, "what long, total long")

    sums = states.mapInArrow(run, "what long, total long").groupBy("what").agg(F.sum("total").alias("n")).collect()
    sums = {r["what"]: r["n"] for r in sums}
    customers = np.array([sums.get(i, 0) for i in range(len(split.hashes))], np.float64)
    tokens = sums.get(-1, 0)
    # an end follows every text of the training rows, so it is known if any token is
    words = sums.get(-2, 0) + int(((customers > 0) & (split.hashes != START)).sum()) + (tokens > 0)
    return _Totals(tokens, words, (0.0,), (float(words),)), _Split(split.hashes, split.parts, customers, split.tables)


def _split_tables(states: DataFrame, split: _Split, samples: int) -> _Split:
    """``split`` with the tables of its contexts, summed over their shards."""
    if not len(split.hashes):
        return _Split(split.hashes, split.parts, split.customers, np.zeros((samples, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                seated = _Seating.of(body.as_buffer())
                at, hot = split.find(seated.contexts)
                rows = []
                for s, tables in enumerate(seated.all_samples(samples)):
                    own = np.bincount(seated.owner, tables, len(hot)).astype(np.int64)
                    rows += [(int(i), s, int(n)) for i, n in zip(at[hot], own[hot], strict=True)]
                yield _rows(rows, "what long, sample long, total long")

    tables = np.zeros((samples, len(split.hashes)))
    for row in states.mapInArrow(run, "what long, sample long, total long").groupBy("what", "sample").agg(F.sum("total").alias("n")).collect():
        tables[row["sample"], row["what"]] = row["n"]
    return _Split(split.hashes, split.parts, split.customers, tables)


_DOWN = "shard int, parent int, served array<long>, tables array<long>, body binary"


def _parents(states: DataFrame, model: PitmanYor, totals: _Totals, n_parents: int, samples: int, salt: int) -> DataFrame:
    """What parent shards tell context shards: of each word these have, in
    their order, the parent's customers and tables in each sample.  A row of
    shard -1 has a parent shard's sums of both."""
    base = (model.parent_strength + model.parent_discount * totals.tables[-1]) / (totals.words + 1)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages(shard, body):
            seated = _Seating.of(body.as_buffer())
            sums = np.stack([np.bincount(seated.word, t, len(seated.words)).astype(np.int32) for t in seated.all_samples(samples)])
            for parent, p in _present(_range_of(seated.words, 48, n_parents)):
                yield parent, shard, _pack(_six(seated.words[p]), sums[:, p].ravel())

        for batch in batches:
            for shard, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(messages(shard, body), "parent int, shard int, body binary")

    def seat(group: pa.Table) -> pa.Table:
        stirling, parent = _Stirling(model.parent_discount), group["parent"][0].as_py()
        rng = np.random.default_rng([model.seed, parent, 2, salt])
        group = group.sort_by("shard")
        told = [_unpack(x.as_buffer(), np.uint8, np.int32) for x in group["body"]]
        words, at = np.unique(np.concatenate([_of_six(w) for w, _ in told]), return_inverse=True)
        ends = np.cumsum([len(w) // 6 for w, _ in told])
        served = np.stack([np.bincount(at, np.concatenate([t.reshape(samples, -1)[s] for _, t in told]), len(words)) for s in range(samples)]).astype(np.int64)
        tables = np.stack([_sweep(x, np.minimum(x, 1), np.full(len(x), base), stirling, rng) for x in served])
        rows = [(-1, parent, served.sum(axis=1).tolist(), tables.sum(axis=1).tolist(), b"")]
        for shard, own in zip(group["shard"].to_pylist(), np.split(at, ends[:-1]), strict=True):
            rows.append((shard, parent, None, None, _pack(served[:, own].astype(np.int32).ravel(), tables[:, own].astype(np.int32).ravel())))
        return pa.Table.from_batches([_rows(rows, _DOWN)])

    return states.mapInArrow(up, "parent int, shard int, body binary").groupBy("parent").applyInArrow(seat, _DOWN)


def _summed(told: DataFrame, totals: _Totals, samples: int) -> _Totals:
    sums = [F.sum(F.col(c)[s]).alias(f"{c}{s}") for c in ("served", "tables") for s in range(samples)]
    row = told.where("shard = -1").agg(*sums).first()
    served, tables = (tuple(float(row[f"{c}{s}"] or 0) for s in range(samples)) for c in ("served", "tables"))
    return _Totals(totals.tokens, totals.words, served, tables)


def _probabilities(told: list, model: PitmanYor, totals: _Totals) -> np.ndarray:
    """The parent's probability of each word, by sample, from the messages of
    parent shards in their order."""
    samples = len(totals.served)
    parts = [[x.reshape(samples, -1) for x in _unpack(body.as_buffer(), np.int32, np.int32)] for body in told]
    served, tables = (np.concatenate(x, axis=1) for x in zip(*parts, strict=True))
    return np.stack([_parent_probability(model, served[s], tables[s], totals, s) for s in range(samples)])


def _parent_probability(model: PitmanYor, served: np.ndarray, tables: np.ndarray, totals: _Totals, sample: int) -> np.ndarray:
    base = 1.0 / (totals.words + 1)
    back = model.parent_strength + model.parent_discount * totals.tables[sample]
    return (served - model.parent_discount * tables + back * base) / (model.parent_strength + totals.served[sample])


def _swept(states: DataFrame, told: DataFrame, model: PitmanYor, totals: _Totals, split: _Split, *, keep: bool, salt: int) -> DataFrame:
    """States after a round's sweeps, whose tables take the place of the
    last ones, or follow them with ``keep``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        stirling, shard = _Stirling(model.discount), left["shard"][0].as_py()
        rng = np.random.default_rng([model.seed, shard, 1, salt])
        seated = _Seating.of(left["body"][0].as_buffer())
        owner, n = seated.owner, len(seated.contexts)
        p = _probabilities(right.sort_by("parent")["body"], model, totals)[-1]
        tables = seated.tables[-1].astype(np.int64)
        at, hot = split.find(seated.contexts)
        elsewhere = np.zeros(n)
        elsewhere[hot] = split.tables[-1][at[hot]] - np.bincount(owner, tables, n)[hot]
        for _ in range(model.sweeps):
            opens = model.strength + model.discount * (elsewhere + np.bincount(owner, tables, n))
            tables = _sweep(seated.customers, tables, opens[owner] * p[seated.word], stirling, rng)
        seated.tables = np.concatenate([seated.tables, tables[None]]) if keep else tables[None]
        return pa.Table.from_batches([_rows([(shard, seated.body())], _STATE)])

    told = told.where("shard >= 0").select("shard", "parent", "body")
    return states.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(run, _STATE)


class _Stirling:
    """Generalised Stirling numbers S(c, t), as logs, up to ``top`` customers,
    and the chance that one of c customers at t tables sits alone: S(c-1, t-1)
    / S(c, t).  Beyond ``top`` that chance is the share of ones among table
    sizes drawn alike, with weights z ** size, whose mean is c / t."""

    def __init__(self, discount: float, top: int = 128):
        s = np.full((top + 1, top + 1), -np.inf)
        s[0, 0] = 0
        t = np.arange(1, top + 1)
        with np.errstate(divide="ignore"):
            for c in range(top):
                stay = s[c, 1:] + np.log(np.maximum(c - discount * t, 0))
                s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay)
        with np.errstate(invalid="ignore"):
            alone = np.exp(s[:-1, :-1] - s[1:, 1:])
        self.log, self.table = s, np.nan_to_num(np.clip(alone, 0, 1), nan=1.0)
        self.top, self.discount = top, discount
        u = np.exp(-np.concatenate([np.geomspace(1e-6, 1, 2000), np.linspace(1, 600, 6000)[1:]]))  # 1 - z
        self.ones = (1 - u) * discount / (1 - u**discount)
        self.log_mean = np.log(self.ones) - (1 - discount) * np.log(u)

    def alone(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        small = customers <= self.top
        c, t = np.where(small, customers, 1), np.where(small, tables, 1)
        share = np.maximum(tables - 1, 0) / np.maximum(customers - 1, 1)
        far = share * np.interp(-np.log(np.maximum(share, 1e-300)), self.log_mean, self.ones)
        return np.where(small, self.table[c - 1, t - 1], np.minimum(far, 1))


def _sweep(customers, tables, new, stirling, rng) -> np.ndarray:
    """Reseat every customer of every dish; ``new`` is the weight of a new
    table.  Tables are drawn from their distribution, S(c, t) new ** t: as it
    is up to ``stirling.top`` customers, by a binomial beyond."""
    tables = tables.copy()
    at = np.flatnonzero(customers > 1)
    size = np.minimum(customers[at], stirling.top + 1).astype(np.int16)
    at = at[np.argsort(size, kind="stable")]
    cuts = np.searchsorted(np.sort(size, kind="stable"), np.arange(2, stirling.top + 2))
    for c, x, y in zip(range(2, stirling.top + 1), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if y > x:
            weight = stirling.log[c, 1 : c + 1] + np.log(new[at[x:y]])[:, None] * np.arange(c)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1)[:, None]), axis=1)
            tables[at[x:y]] = 1 + (weight[:, :-1] <= rng.random(y - x)[:, None] * weight[:, -1:]).sum(axis=1)
    many = at[cuts[-1] :]
    if len(many):
        tables[many] = _many(customers[many], new[many], stirling, rng)
    return tables


def _many(customers: np.ndarray, new: np.ndarray, stirling: _Stirling, rng) -> np.ndarray:
    """Tables of dishes of many customers: the tables after the first are
    binomial, fitted to how S(c, t + 1) / S(c, t) * new goes around the mode."""
    c = customers.astype(np.int64)

    def odds(t):  # of t + 1 tables against t
        stay = np.maximum(1 - stirling.alone(c, t), 0)
        return new * stay / (np.maximum(c - 1 - stirling.discount * t, 1e-9) * stirling.alone(c, np.minimum(t + 1, c)))

    low, high = np.ones(len(c), np.int64), c - 1  # the mode, or one before it
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        up = odds(middle) >= 1
        low, high = np.where(open_ & up, middle, low), np.where(open_ & ~up, middle - 1, high)
    step = np.minimum(np.maximum(np.sqrt(low).astype(np.int64), 1), c - low)
    here, there = odds(low) * low, odds(low + step) * (low + step)
    ratio = np.maximum((here - there) / step, 1e-6)
    trials = np.maximum(np.rint(low - 1 + here / ratio), low).astype(np.int64)
    success = here / np.maximum(trials - low + 1, 1e-9)
    return np.clip(1 + rng.binomial(trials, success / (1 + success)), 1, c)


def predictive(seated: _Seating, p: np.ndarray, model: PitmanYor, split: _Split) -> tuple[np.ndarray, np.ndarray]:
    """Customers of each context, and the averaged probability of each pair;
    ``p`` has the parent's probabilities by sample and word."""
    owner, n = seated.owner, len(seated.contexts)
    at, hot = split.find(seated.contexts)
    customers = np.bincount(owner, seated.customers, n).astype(np.int64)
    customers[hot] = split.customers[at[hot]]
    total = np.zeros(len(owner))
    for s, tables in enumerate(seated.all_samples(len(p))):
        every = np.bincount(owner, tables, n)
        every[hot] = split.tables[s][at[hot]]
        opens = model.strength + model.discount * every
        total += seated.customers - model.discount * tables + opens[owner] * p[s][seated.word]
    return customers, total / len(p) / (model.strength + customers)[owner]


def _answers(states: DataFrame, told: DataFrame, requests: DataFrame, model: PitmanYor, totals: _Totals, split: _Split) -> DataFrame:
    """What blocks asked, in the order asked: customers of the contexts, and
    log10 probabilities of the pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return pa.Table.from_batches([_rows([], _MESSAGE)])
        left = left.sort_by("parent")  # the state has -1
        bodies = left["body"]
        seated, p = _Seating.of(bodies[0].as_buffer()), _probabilities(bodies[1:], model, totals)
        customers, chance = predictive(seated, p, model, split)
        score, keys = np.log10(chance).astype(np.float32), seated.owner * len(seated.words) + seated.word
        shard, out = right["shard"][0].as_py(), []
        for block, body in zip(right["block"].to_pylist(), right["body"], strict=True):
            contexts, words, _ = _asked(body.as_buffer())
            context = np.searchsorted(seated.contexts, contexts)
            pair = np.searchsorted(keys, context * len(seated.words) + np.searchsorted(seated.words, words))
            out.append((shard, block, _pack(customers[np.searchsorted(seated.contexts, _runs(contexts)[0])], score[pair])))
        return pa.Table.from_batches([_rows(out, _MESSAGE)])

    known = states.select("shard", F.lit(-1).alias("parent"), "body")
    known = known.unionByName(told.where("shard >= 0").select("shard", "parent", "body"))
    return known.groupBy("shard").cogroup(requests.groupBy("shard")).applyInArrow(run, _MESSAGE)


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scored(blocks: DataFrame, answers: DataFrame, totals: _Totals, split: _Split, n_shards: int, texts: int) -> DataFrame:
    whole = math.log10(totals.tokens + totals.words + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left["body"][0].as_buffer(), split, n_shards)
        told = [_unpack(x.as_buffer(), np.int64, np.float32) for x in right.sort_by("shard")["body"]]
        per = np.concatenate([_runs(block.contexts[p])[1] for _, p in _present(block.shards)])
        customers = np.repeat(np.concatenate([c for c, _ in told]), per)[block.pair]
        counts = np.full(len(block.pair), texts)  # an end was seen once a text
        # a word was seen as often as it was a context, which it is of the next token
        inner = np.flatnonzero(~block.is_end)
        counts[inner] = customers[inner + 1]
        chances = np.concatenate([x for _, x in told])[block.pair].astype(np.float64)
        starts = np.cumsum(block.lengths) - block.lengths
        sums = lambda x: np.add.reduceat(x, starts)
        cols = [
            pa.array(block.ids, pa.int64(), mask=block.empty_id.astype(bool)), pa.array(block.held.astype(bool)), pa.array(block.lengths),
            pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(starts), totals.tokens)),
            pa.array(sums(np.log10(counts + 1.0) - whole)), pa.array(sums(chances)),
        ]
        return pa.table(cols, [x.split()[0] for x in SCORES.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


def held_out(doc_id: str, parts: int = 7, rest: int = 2) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == rest, F.lit(False))


def score_texts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: PitmanYor | None = None
) -> DataFrame:
    """Learn from the rows that are not held out and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add
    one unigrams) and score, in log10; perplexity is 10 ** (-score / n_tokens).
    Null and empty texts are the end token alone.  Null ids are never held
    out; repeated rows count and are scored one by one.  An empty table gives
    no rows; other columns are ignored.
    """
    model = model or PitmanYor()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held"), F.col(text).cast("string").alias("text"))
    size, texts = rows.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held"))).first()
    # texts take about twice their bytes of compressed input
    n_shards = max(model.least_shards, -(-(size or 0) // (2 * model.shard_bytes)))
    n_parents = -(-n_shards // 4)
    split = _frequent(rows, model, n_shards)
    blocks = materialise(_to_blocks(rows, model), "blocks", compression="none")
    seat = lambda df: materialise(df, "seated", compression="none")
    states = seat(_first_seating(_requests(blocks, split, n_shards, range(n_shards))))
    totals, split = _corpus(states, split)
    samples = 1
    for turn in range(model.burn_in + model.samples):
        split = _split_tables(states, split, samples)
        told = seat(_parents(states, model, totals, n_parents, samples, turn))
        totals = _summed(told, totals, samples)
        keep = turn > model.burn_in
        before, states = states, seat(_swept(states, told, model, totals, split, keep=keep, salt=turn))
        discard(before)
        discard(told)
        samples += keep
    split = _split_tables(states, split, samples)
    told = seat(_parents(states, model, totals, n_parents, samples, model.burn_in + model.samples))
    totals = _summed(told, totals, samples)
    answers = []
    for turn in range(model.passes):
        wanted = range(turn * n_shards // model.passes, (turn + 1) * n_shards // model.passes)
        own = lambda df: df.where(F.col("shard").between(wanted.start, wanted.stop - 1))  # noqa: B023, E731
        answers.append(seat(_answers(own(states), own(told), _requests(blocks, split, n_shards, wanted), model, totals, split)))
    discard(states)
    discard(told)
    every = answers[0]
    for more in answers[1:]:
        every = every.unionByName(more)
    return _scored(blocks, every, totals, split, n_shards, texts or 0)
