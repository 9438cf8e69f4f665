"""Quality classifier: a factorisation machine over a document's text.

The score is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, its pairwise part
computed in linear time as half of |sum v_i x_i|^2 - sum |v_i x_i|^2 per
factor.  Features are hashed words, statistics of the text's structure and its
declared length.  Features are extracted in Arrow batches on the executors;
training sees a bounded sample of labelled rows, scoring sees every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckloom.llm.text import column_bytes, spans, text_slices, word_hashes

#: Buckets that words are hashed to.
BUCKETS = 1 << 13
#: Equal bins over [0, 1] that each statistic is spread over, beside its value.
BINS = 8
STATISTICS = (
    "upper", "digit", "symbol", "pipe", "wide", "word_length", "word_length_spread", "distinct_words", "top_word",
    "repeated_next", "line_length", "repeated_lines", "shouted_words", "marked_words", "size", "declared_size", "undeclared",
)
N_FEATURES = BUCKETS + len(STATISTICS) * (BINS + 1)


def _class_table(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_UPPER, _DIGIT = _class_table(range(65, 91)), _class_table(range(48, 58))
_SYMBOL = _class_table([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_PIPE, _WIDE, _LETTER = _class_table([124]), _class_table(range(128, 256)), _class_table([*range(65, 91), *range(97, 123)])


def statistics(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, declared: np.ndarray) -> np.ndarray:
    """One row of values in [0, 1] per text; ``declared`` holds lengths, NaN
    where unknown."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    some = np.maximum(size, 1)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return np.diff(total[offsets]) / some

    starts, ends, counts = spans(raw, offsets)
    owner = np.repeat(np.arange(n), counts)
    n_words = np.maximum(counts, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / n_words
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / n_words - mean**2, 0))
    key, times = _pairs(owner, words)
    distinct = np.bincount(key, minlength=n) / n_words
    top = np.zeros(n)
    np.maximum.at(top, key, times)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    up = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    low = np.concatenate([[0], np.cumsum(_LETTER[raw] & ~_UPPER[raw])])
    shouted = (up[ends] - up[starts] > 1) & (low[ends] == low[starts])
    marked = _SYMBOL[raw[ends - 1]] & _SYMBOL[raw[np.maximum(ends - 2, starts)]] & (length > 2) if len(ends) else np.zeros(0, bool)
    lines, repeated = np.zeros(n), np.zeros(n)
    for i in range(n):
        own = raw[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        lines[i], repeated[i] = len(own), 1 - len(set(own)) / len(own)
    known = ~np.isnan(declared)
    return np.clip(
        np.stack(
            [
                share(_UPPER), share(_DIGIT), 2 * share(_SYMBOL), 5 * share(_PIPE), share(_WIDE), mean / 16, spread / 8,
                distinct * (counts > 0), top / n_words, np.bincount(owner, same, n) / n_words,
                np.log1p(size / np.maximum(lines, 1)) / 8, repeated, np.bincount(owner, shouted, n) / n_words,
                np.bincount(owner, marked, n) / n_words, np.log1p(size) / 14,
                np.log1p(np.maximum(np.where(known, declared, 0), 0)) / 14, ~known,
            ],
            axis=1,
        ),
        0,
        1,
    )


def _pairs(owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each distinct word of each text."""
    order = np.lexsort((words, owner))
    o, w = owner[order], words[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], np.diff(np.append(at, len(w)))


def features(texts: pa.Array, declared: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature indexes, values, and each row's number of them."""
    raw, offsets = column_bytes(texts)
    words, counts = word_hashes(texts)
    n = len(counts)
    lengths = np.full(n, np.nan)
    if declared is not None:
        lengths = declared.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(n), counts)
    cell, times = np.unique(owner * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    value = np.sqrt(times)
    norm = np.sqrt(np.bincount(cell // BUCKETS, value**2, n))
    value = value / norm[cell // BUCKETS]
    stats = statistics(raw, offsets, words, lengths)
    width = len(STATISTICS)
    base = BUCKETS + np.arange(width) * (BINS + 1)
    bins = base + 1 + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    rows = np.concatenate([cell // BUCKETS, np.repeat(np.arange(n), 2 * width)])
    index = np.concatenate([cell % BUCKETS, np.concatenate([np.broadcast_to(base, bins.shape), bins], axis=1).ravel()])
    values = np.concatenate([value, np.concatenate([stats, np.full(stats.shape, 0.5)], axis=1).ravel()])
    order = np.argsort(rows, kind="stable")
    return index[order].astype(np.int32), values[order].astype(np.float32), np.bincount(rows, minlength=n)


@dataclass(frozen=True)
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, index: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each sparse row."""
        if not len(counts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._margin(index, values, counts)[0], -30, 30)))

    def _margin(self, index, values, counts):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weighted = self.factors[index] * values[:, None]
        first = np.add.reduceat(self.linear[index] * values, starts)
        total = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted**2, starts, axis=0)
        return self.bias + first + 0.5 * (total**2 - squares).sum(axis=1), total, weighted


def train(
    index: np.ndarray, values: np.ndarray, counts: np.ndarray, labels: np.ndarray, *, rank: int = 8, epochs: int | None = None, seed: int = 7
) -> FactorisationMachine:
    """Logistic loss by Adagrad over mini-batches, with weight decay; small
    samples are passed more often, so that all are learnt as well.

    Without examples every text scores one half.
    """
    epochs = epochs or int(np.clip(30_000 / max(1, len(labels)), 8, 80))
    rng = np.random.default_rng(seed)
    linear = np.zeros(N_FEATURES, np.float32)
    factors = rng.normal(0, 0.05, (N_FEATURES, rank)).astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, g_bias = float(np.log(share / (1 - share))), 1e-3
    g_linear, g_factors = np.full(linear.shape, 1e-3, np.float32), np.full(factors.shape, 1e-3, np.float32)
    starts = np.concatenate([[0], np.cumsum(counts)])
    for epoch in range(epochs):
        step, order = 0.1 / (1 + epoch / 2), rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            own = counts[rows]
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            i, x = index[take], values[take]
            margin, total, weighted = FactorisationMachine(bias, linear, factors)._margin(i, x, own)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]
            per = np.repeat(error / len(rows), own).astype(np.float32)
            touched, back = np.unique(i, return_inverse=True)
            d_linear = np.bincount(back, per * x, len(touched)) + 1e-5 * linear[touched]
            d_factors = np.zeros((len(touched), rank), np.float32)
            np.add.at(d_factors, back, (per * x)[:, None] * (np.repeat(total, own, axis=0) - weighted))
            d_factors += 1e-4 * factors[touched]
            g_bias += error.mean() ** 2
            bias -= step * error.mean() / np.sqrt(g_bias)
            g_linear[touched] += d_linear**2
            g_factors[touched] += d_factors**2
            linear[touched] -= step * d_linear / np.sqrt(g_linear[touched])
            factors[touched] -= step * d_factors / np.sqrt(g_factors[touched])
    return FactorisationMachine(bias, linear, factors)


#: Most labelled rows that training collects, those of the smallest id hashes.
TRAINING_ROWS = 12_000


def held_out(doc_id: str, parts: int = 5) -> F.Column:
    """Whether a row is kept from training: crc32 of the id's text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    declared: str | None = "n_chars",
    label: str = "quality",
    training_rows: int = TRAINING_ROWS,
) -> FactorisationMachine:
    """Learn from labelled rows that are not held out.

    At most ``training_rows`` rows take part; labels of one id that disagree
    count as the larger, null labels and ids as absent.  Null texts count as
    empty, repeated rows as examples of their own.  A table without the column
    ``declared`` is learnt without it; other columns, whatever their names,
    are ignored.  Without labelled rows every text scores one half.
    """
    declared = declared if declared in docs.columns else None
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id"))
    known = known.agg((F.max(label) > 0).alias("__label")).where(~held_out("__id"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(training_rows)
    extra = [F.col(declared).cast("double").alias("__declared")] if declared else []

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            index, values, counts = features(batch.column(2), batch.column(3) if declared else None)
            ends = np.concatenate([[0], np.cumsum(counts)])
            cut = lambda a: pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(ends * 4), pa.py_buffer(np.ascontiguousarray(a))]
            ).cast(pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), cut(index), cut(values)], ["id", "label", "index", "value"])

    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), *extra)
    rows = rows.join(F.broadcast(known), "__id").select("__id", "__label", "__text", *["__declared" for _ in extra])
    rows = rows.mapInArrow(extract, "id long, label boolean, index binary, value binary")
    rows = rows.orderBy(F.xxhash64("id"), "id", "index", "value").limit(training_rows).toArrow()
    index = [np.frombuffer(x, np.int32) for x in rows["index"].to_pylist()]
    values = [np.frombuffer(x, np.float32) for x in rows["value"].to_pylist()]
    none = np.zeros(0)
    return train(
        np.concatenate([none.astype(np.int32), *index]),
        np.concatenate([none.astype(np.float32), *values]),
        np.array([len(x) for x in index], np.int64),
        np.array(rows["label"].to_pylist(), float),
    )


def score_quality(
    docs: DataFrame,
    model: FactorisationMachine,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    declared: str | None = "n_chars",
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null text counts as empty, which has a score like any other; null ids and
    repeated rows are scored one by one.  Other columns are ignored; an empty
    table gives no rows.
    """
    declared = declared if declared in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            scores = model.score(*features(part.column(2), part.column(3) if declared else None))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(scores)], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        F.col(text).alias("text"),
        *([F.col(declared).cast("double").alias("declared")] if declared else []),
    )
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: FactorisationMachine, *, text: str = "text", declared: str | None = "n_chars", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns kept, that score at least ``threshold``.

    Null texts are judged as empty ones; repeated rows and null ids one by one;
    an empty table stays empty.  Columns of any name are allowed: none is added.
    """
    at, declared_at = docs.columns.index(text), docs.columns.index(declared) if declared in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            known = part.column(declared_at) if declared_at is not None else None
            yield part.filter(pa.array(model.score(*features(part.column(at), known)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
