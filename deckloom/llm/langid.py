"""Language identification by Bayesian fusion of evidence.

Each row has a likelihood of its text under every language (hashed trigrams of
its letters), a declared language from its markup or metadata, and an address.
Grouped aggregation of the text-only posteriors gives how often each declared
value goes with each language, and how often each host, domain and address
suffix has it; every level is smoothed by the one above it, and a row's own
part is taken out of its host's counts.  The posterior is the product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from deckloom.llm.html_extract import host_of, parse
from deckloom.llm.store import materialise
from deckloom.llm.text import column_bytes, text_slices

BUCKETS = 1 << 14
#: Bytes by class: letters keep a lower-case value, all else is a gap of 0.
_FOLD = np.zeros(256, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that hold a letter, and their number a text."""
    raw, offsets = column_bytes(column)
    n = len(offsets) - 1
    if len(raw) < 3:
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    x = _FOLD[raw]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    keep = (x[1:-1] != 0) & ((x[:-2] != 0) | (x[2:] != 0))
    inner = offsets[1:-1]
    for back in (1, 2):  # none across two texts
        cut = inner - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    at = np.flatnonzero(keep)
    bucket = ((code[at] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int32)
    return bucket, np.diff(np.searchsorted(at, offsets))


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of buckets, a column a language.  Trigrams of one
    text repeat each other, so a text of n trigrams weighs n / (1 + n / alike)
    of them, and other evidence keeps a say.  ``usual`` has, a row a
    language, the mean of log probabilities over its training texts, the
    variance of texts' means and that within texts: a text that lies more than
    ``far`` deviations below what is usual in every language has none."""

    languages: tuple[str, ...]
    log_probability: np.ndarray
    usual: np.ndarray
    alike: float = 150.0
    far: float = 12.0

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihoods, numbers of trigrams, and whether a text may be of
        a language of the model; one without trigrams may."""
        bucket, counts = _trigrams(column)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros((len(counts), len(self.languages)))
        for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if y > x:
                out[i] = self.log_probability[bucket[x:y]].sum(axis=0)
        mean = out / np.maximum(counts, 1)[:, None]
        within = self.usual[:, 2] / np.maximum(counts, 1)[:, None]
        usual = mean >= self.usual[:, 0] - self.far * np.sqrt(self.usual[:, 1] + within)
        return mean * (counts / (1 + counts / self.alike))[:, None], counts, usual.any(axis=1) | (counts == 0)


def fit_text_model(
    rows: DataFrame, *, text: str, declared: str, row_id: str, training_rows: int = 8000, each: int = 500, support: int = 50, least: float = 0.01, trigrams: int = 200
) -> TextModel:
    """Learn trigrams from about ``training_rows`` rows, picked by a hash of
    their id, and about ``each`` of every language that has fewer among them,
    taking the declared languages as labels.

    Languages are the declared values that ``support`` rows of the whole table
    name, or a share of ``least`` in smaller tables, and whose picked rows have
    ``trigrams`` trigrams; scattered wrong declarations only add a little
    noise.  Without such rows the model knows no language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            bucket, counts = _trigrams(batch.column(1))
            names, index = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            owner = np.repeat(index, counts).astype(np.int64)
            cell, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
            seen = np.bincount(index, minlength=len(names))
            rows_at = np.concatenate([cell // BUCKETS, np.arange(len(names))])
            buckets = np.concatenate([cell % BUCKETS, np.full(len(names), -1)])  # -1: the number of rows
            yield pa.record_batch(
                [pa.array(names[rows_at].tolist(), pa.string()), pa.array(buckets, pa.int64()), pa.array(np.concatenate([times, seen]), pa.int64())],
                ["language", "bucket", "n"],
            )

    labelled = rows.select(F.lower(F.trim(declared)).alias("language"), F.col(text).alias("text"), F.col(row_id).alias("id"))
    labelled = labelled.where("language IS NOT NULL AND language != ''")
    said = labelled.groupBy("language").agg(F.count("*").alias("n"))
    said = materialise(said, "declared")
    total = said.agg(F.sum("n")).first()[0] or 0
    named = {r["language"]: r["n"] for r in said.where(F.col("n") >= min(support, least * total)).collect()}
    if not named:
        return TextModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 3)))
    every = {x: max(1, int(n // max(each, training_rows * n / total))) for x, n in named.items()}
    one_of = F.create_map(*[F.lit(v) for x in every.items() for v in x])[F.col("language")]
    picked = labelled.where(F.col("language").isin(*named)).where(F.pmod(F.xxhash64(F.lit(5), "id"), one_of) == 0).select("language", "text")
    picked = materialise(picked, "training")
    counts = materialise(picked.mapInArrow(run, "language string, bucket long, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    sizes = counts.where("bucket >= 0").groupBy("language").agg(F.sum("n").alias("size"))
    languages = tuple(sorted(r["language"] for r in sizes.where(F.col("size") >= trigrams).collect()))
    table = np.full((BUCKETS, len(languages)), 0.2)
    column = {x: i for i, x in enumerate(languages)}
    for r in counts.where(F.col("language").isin(*languages) & (F.col("bucket") >= 0)).toLocalIterator() if languages else ():
        table[r["bucket"], column[r["language"]]] += r["n"]
    size = table.sum(axis=0)
    log_probability = np.log(table / size).astype(np.float32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            bucket, number = _trigrams(batch.column(1))
            owner = np.array([column.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            ok = (owner >= 0) & (number > 0)
            of = np.repeat(np.arange(len(owner)), number)
            at = owner[of]
            # a text's own part is taken out of its language's counts
            cell, place, times = np.unique(of * BUCKETS + bucket, return_inverse=True, return_counts=True)
            left = np.maximum(table[bucket, at] - times[place], 0.2)
            x = np.log(left / np.maximum(size[at] - number[of], 1.0))
            n = np.maximum(number, 1)
            mean = np.bincount(of, x, len(owner)) / n
            within = np.maximum(np.bincount(of, x * x, len(owner)) / n - mean**2, 0)
            yield pa.record_batch([pa.array(v[ok]) for v in (owner, mean, within)], ["owner", "mean", "within"])

    usual = np.zeros((len(languages), 3))
    if languages:
        spreads = picked.mapInArrow(spread, "owner long, mean double, within double").groupBy("owner")
        for r in spreads.agg(F.avg("mean").alias("m"), F.var_pop("mean").alias("b"), F.avg("within").alias("w")).collect():
            usual[r["owner"]] = r["m"], r["b"], r["w"]
    return TextModel(languages, log_probability, usual)


@dataclass(frozen=True)
class Fusion:
    """Strengths of smoothing: imagined rows of the level above at each host,
    domain and suffix, and at each declared value."""

    host: float = 10.0
    domain: float = 20.0
    suffix: float = 50.0
    declared: float = 5.0
    least: float = 0.5


def _vector_sum(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])


def _smoothed(counts: Column, above: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + F.lit(strength) * p) / (total + F.lit(strength)))


#: The columns that :func:`fuse` reads and those that it adds.
EVIDENCE = ("likelihood", "n_trigrams", "declared", "host", "known")
FOUND = ("language", "confidence", "text_language", "accepted")


def fuse(evidence: DataFrame, languages: tuple[str, ...], settings: Fusion | None = None) -> DataFrame:
    """Add ``language``, ``confidence``, ``text_language`` and ``accepted`` to
    rows of evidence: ``likelihood`` (log, by language), ``n_trigrams``,
    ``declared`` and ``host``.

    Missing evidence takes no side: null hosts and declarations, and null or
    zero ``n_trigrams``.  Texts without trigrams follow the other evidence, but
    are never accepted; nor are rows whose best language has less than
    ``least``.  Rows that a column ``known`` denies are of no language of the
    model: they have none and are no evidence for others.  Rows are never
    merged; an empty table gives no rows.  Other columns stay as they are,
    whatever their names, but those of the four that are added are replaced.
    """
    s, n = settings or Fusion(), len(languages)
    kept = [c for c in evidence.columns if c != "known" and c not in FOUND]
    own = [c for c in EVIDENCE if c in evidence.columns]
    row = F.struct(*kept).alias("row")
    if not n:
        none = {c: F.lit(None).cast("string") for c in ("language", "text_language")} | {"confidence": F.lit(0.0), "accepted": F.lit(False)}
        return evidence.select(*kept, *[none[c].alias(c) for c in FOUND])
    evidence = evidence.select(row, *own)  # names of other columns can't clash with those below
    if "known" not in own:
        evidence = evidence.withColumn("known", F.lit(True))
    evidence = evidence.withColumns({"n_trigrams": F.coalesce("n_trigrams", F.lit(0)), "known": F.coalesce("known", F.lit(True))})
    names = F.array(*[F.lit(x) for x in languages])
    top = F.array_max("likelihood")
    weight = F.transform("likelihood", lambda x: F.exp(x - top))
    rows = evidence.withColumns(
        {
            "own": F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, y: a + y)),
            "claim": F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared") != "", F.lit("?")),
            "domain": F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1),
            "suffix": F.regexp_extract("host", r"\.([^.]+)$", 1),  # empty for hosts of one label
        }
    )
    rows = materialise(rows, "evidence")
    some = rows.where("n_trigrams > 0 AND known")
    hosts = some.where("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(_vector_sum("own", n).alias("host_n"))
    hosts = materialise(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(_vector_sum("host_n", n).alias("domain_n"))
    suffixes = domains.groupBy("suffix").agg(_vector_sum("domain_n", n).alias("suffix_n"))
    world = some.agg(_vector_sum("own", n).alias("x")).first()["x"]
    world = [(x or 0.0) + 1.0 for x in world]
    prior = F.array(*[F.lit(x / sum(world)) for x in world])
    suffixes = suffixes.select("suffix", _smoothed(F.col("suffix_n"), prior, s.suffix).alias("suffix_p"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", _smoothed(F.col("domain_n"), F.col("suffix_p"), s.domain).alias("domain_p"))
    hosts = hosts.join(domains, ["domain", "suffix"]).select("host", "host_n", "domain_p")
    # rows of claims: at most one a language, and one for all others
    claims = some.where("claim IS NOT NULL").groupBy("claim").agg(_vector_sum("own", n).alias("x")).collect()
    table = np.array([next((r["x"] for r in claims if r["claim"] == c), [0.0] * n) for c in (*languages, "?")])
    flat = np.full(table.shape, s.declared / (n + 1))
    flat[np.arange(n), np.arange(n)] += s.declared
    chance = (table + flat) / (table + flat).sum(axis=0)
    told = F.create_map(*[x for c, p in zip((*languages, "?"), chance, strict=True) for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in p]))])
    neutral = F.array(*[F.lit(1.0)] * n)
    rows = rows.join(hosts, "host", "left")
    own = F.when(F.col("n_trigrams") > 0, F.col("own")).otherwise(F.transform("own", lambda x: x * 0))
    others = F.zip_with("host_n", own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    place = F.coalesce(_smoothed(others, F.col("domain_p"), s.host), prior)
    claim = F.coalesce(F.try_element_at(told, F.col("claim")), neutral)
    joint = F.zip_with(F.zip_with("own", place, lambda a, b: a * b), claim, lambda a, b: a * b)
    rows = rows.withColumn("joint", joint)
    rows = rows.withColumn("confidence", F.when(F.col("known"), F.array_max("joint") / F.aggregate("joint", F.lit(0.0), lambda a, x: a + x)).otherwise(0.0))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    rows = rows.withColumns(
        {
            "language": F.when(F.col("known"), best("joint")),
            "text_language": F.when((F.col("n_trigrams") > 0) & F.col("known"), best("own")),
            "accepted": F.col("known") & (F.col("n_trigrams") > 0) & (F.col("confidence") >= s.least),
        }
    )
    return rows.select("row.*", *FOUND)


def _likelihoods(rows: DataFrame, model: TextModel, text: str) -> DataFrame:
    """All columns but ``text``, and the likelihoods."""
    at = rows.columns.index(text)
    kept = [f for f in rows.schema if f.name != text]
    more = [StructField("likelihood", ArrayType(DoubleType())), StructField("n_trigrams", LongType()), StructField("known", BooleanType())]
    schema = StructType([*kept, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, at):
            values, counts, known = model.likelihoods(part.column(at))
            width = len(model.languages)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * width, pa.int32()), pa.array(values.ravel()))
            columns = [c for i, c in enumerate(part.columns) if i != at]
            yield pa.record_batch([*columns, lists, pa.array(counts), pa.array(known)], schema.names)

    return rows.mapInArrow(run, schema)


def page_texts(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """page_id, url, declared, host and the main text of pages: what markup
    declares, ``lang`` of the html element or a content-language, to the
    primary tag."""
    tag = r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})"
    meta = r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})"
    said = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(content, p, 1)), F.lit("")) for p in (tag, meta)])
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), said.alias("declared"), host_of(F.col(url)).alias("host"),
        F.col(content).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column(4):
                page = parse(x.as_py()) if x.is_valid else None
                best = page.best() if page else None
                texts.append("\n".join(page.inside(best)) if best else "")
            yield pa.record_batch([*batch.columns[:4], pa.array(texts, pa.string())], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def identify_pages(pages: DataFrame, *, settings: Fusion | None = None) -> DataFrame:
    """Language of every page: page_id, url, host, declared, text_language,
    language, confidence, accepted.

    Pages that are null, empty or without text have no text language and are
    not accepted; null addresses take the world's prior.  Rows are never
    merged; other columns are ignored; an empty table gives no rows.
    """
    texts = materialise(page_texts(pages), "page-texts")  # pages are parsed once
    model = fit_text_model(texts, text="text", declared="declared", row_id="page_id")
    rows = fuse(_likelihoods(texts, model, "text"), model.languages, settings)
    return rows.select("page_id", "url", "host", "declared", "text_language", "language", "confidence", "accepted")


def identify_documents(docs: DataFrame, *, settings: Fusion | None = None) -> DataFrame:
    """Language of every document: doc_id, source, declared, text_language,
    language, confidence, accepted.

    ``lang`` is what a document declares and ``source`` stands for its host.
    Null and empty texts have no text language and are not accepted; null
    sources take the world's prior.  Rows are never merged; other columns are
    ignored; an empty table gives no rows.
    """
    copy = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("lang")).alias("declared"), F.col("source").alias("host"), F.col("text").cast("string").alias("text")
    )
    model = fit_text_model(docs, text="text", declared="lang", row_id="doc_id")
    rows = fuse(_likelihoods(copy, model, "text"), model.languages, settings)
    return rows.select("doc_id", F.col("host").alias("source"), "declared", "text_language", "language", "confidence", "accepted")


def accepted_documents(docs: DataFrame, *, settings: Fusion | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is accepted: the
    declared language is ``lang``, and ``source`` stands for the host.

    Null and empty texts, and texts without letters, go; null sources take the
    world's prior and null declarations take no side.  Repeated rows are judged
    one by one.  An empty table stays empty.  Columns of any name are allowed:
    rows travel as one struct.
    """
    copy = docs.select(
        F.struct("*").alias("whole"), F.col("text").cast("string").alias("text"), F.lower(F.trim("lang")).alias("declared"), F.col("source").alias("host")
    )
    model = fit_text_model(docs, text="text", declared="lang", row_id="doc_id")
    return fuse(_likelihoods(copy, model, "text"), model.languages, settings).where("accepted").select("whole.*")
