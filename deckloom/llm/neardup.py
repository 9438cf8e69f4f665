"""MinHash near-duplicates by a chosen-path set similarity join.

Texts of equal shingle sets are one node of the graph from the start.  For the
others, independent trees branch on selected minwise tokens: at each level a
path hash selects one or two of a document's minima (1 / similarity of them
expected), and the token there extends the path.  Documents of one path at the
chosen depth are a tree node.  Small nodes, of few members and few shingles in
all, are compared exhaustively on full sets.  Members of other nodes are first
compared with a few leaders of the node.  What these connect needs no more
links; the members left over, if few, are compared with all members, a block of
them in a task, and nodes that leave many are branched deeper, by a byte of
each minimum's hash, and in the end compared in pairs of blocks if branching
cannot split them.  The number of trees follows from the recall wanted for a
pair of exactly the least similarity.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from deckloom.llm.graph import components
from deckloom.llm.store import materialise
from deckloom.llm.text import mix, shingle_hashes, text_slices, word_hashes


@dataclass(frozen=True)
class NearDuplicates:
    """Settings: shingles of ``width`` words, links where 100 * intersection
    is at least ``percent`` * union."""

    width: int = 3
    percent: int = 85
    minima: int = 128
    depth: int = 4
    recall: float = 0.9999
    node: int = 1024  # most members compared in one task
    shingles: int = 1 << 20  # and most of their shingles in all
    leaders: int = 4  # of a larger node, at most 16
    rounds: int = 6
    broadcast_rows: int = 250_000
    seed: int = 20

    def _survival(self) -> float:
        """Chance that a pair of the least similarity shares a node of a tree."""
        similarity, alive = self.percent / 100, 1.0
        second = 1 / similarity - 1
        for _ in range(self.depth):
            one = 1 - similarity * alive
            alive = 1 - (1 - second) * one - second * one**2
        return alive

    @property
    def trees(self) -> int:
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - min(self._survival(), 1 - 1e-9))))

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**63, self.minima, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, self.minima, np.uint64)

    def signatures(self, sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row of minima for each set; no set may be empty."""
        odd, plus = self.seeds()
        out = np.empty((len(counts), self.minima), np.uint64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        first = 0
        while first < len(counts):
            upto = max(first + 1, int(np.searchsorted(ends, ends[first] + 65536, "right")) - 1)
            part, cuts = sets[ends[first] : ends[upto]], ends[first:upto] - ends[first]
            for j in range(self.minima):
                out[first:upto, j] = np.minimum.reduceat(part * odd[j] + plus[j], cuts)
            first = upto
        return out

    def paths(self, signatures: np.ndarray, start: np.ndarray | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Row number and path of every tree node that each row reaches."""
        n, t = len(signatures), self.trees
        row = np.repeat(np.arange(n), t)
        root = mix(np.arange(1, t + 1, dtype=np.uint64) * np.uint64(self.seed + 1000 * salt + 1))
        path = np.tile(root, n)
        if start is not None:
            path = mix(path + np.repeat(start, t))
        second = np.uint64(int((100 / self.percent - 1) * 2**32))
        for _ in range(self.depth):
            pick = mix(path)
            place = (pick % np.uint64(self.minima)).astype(np.int64)
            other = (place + 1 + ((pick >> np.uint64(8)) % np.uint64(self.minima - 1)).astype(np.int64)) % self.minima
            more = np.flatnonzero((pick >> np.uint64(32)) < second)
            path, row = (
                np.concatenate([
                    mix(path * np.uint64(3) + mix(signatures[row, place].astype(np.uint64))),
                    mix(path[more] * np.uint64(5) + mix(signatures[row[more], other[more]].astype(np.uint64))),
                ]),
                np.concatenate([row, row[more]]),
            )
        return row, path

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """The exact test on two sorted sets."""
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingle hashes, their number, and a digest of each text's set."""
    words, counts = word_hashes(column)
    sets, sizes = shingle_hashes(words, counts, width)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    digests = [
        hashlib.blake2b(sets[x:y].tobytes(), digest_size=16).digest() if y > x else None
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]
    return sets, sizes, digests


def _sketches(docs: DataFrame, s: NearDuplicates) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            sets, sizes, digests = _sets(batch.column(1), s.width)
            some = np.flatnonzero(sizes)
            full = s.signatures(sets, sizes[some])
            row, path = s.paths(full)
            order = np.argsort(row, kind="stable")
            paths: list = [None] * len(sizes)
            cuts = np.cumsum(np.bincount(row, minlength=len(some)))[:-1]
            for i, own in zip(some.tolist(), np.split(path[order].view(np.int64), cuts), strict=False):
                paths[i] = own
            short: list = [None] * len(sizes)
            # a minimum's own high bits are near zero in long sets, and its low ones depend on its rule
            for i, own in zip(some.tolist(), mix(full).astype(np.uint8), strict=True):
                short[i] = own.tobytes()
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(short, pa.binary()),
                 pa.array(paths, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "short", "paths"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, short binary, paths array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, s: NearDuplicates) -> DataFrame:
    """(digest, words) of the representatives in ``wanted`` (digest, rep): the
    texts are read again, since most sets are never needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            sets, sizes, digests = _sets(batch.column(1), s.width)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            own = [sets[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(own, pa.binary())], ["digest", "words"])

    ids = wanted.select(F.col("rep").alias("__rep")).distinct()
    if wanted.count() <= s.broadcast_rows:  # eight bytes each; beyond, a join by shuffle
        ids = F.broadcast(ids)
    some = docs.join(ids, docs.doc_id.eqNullSafe(F.col("__rep")), "left_semi").mapInArrow(run, "digest binary, words binary")
    return some.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("words").alias("words"))


def _confirmed(stars: DataFrame, sets: DataFrame, s: NearDuplicates) -> DataFrame:
    """The links (a, b) among leaders ``a`` and members ``b``, by full sets.

    A leader's set goes to ``parts`` groups of its members, each of about the
    size of a small node, so that large stars are not one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array([s.linked(p, q) for p, q in zip(x, y, strict=True)], pa.bool_()))

    parts = stars.groupBy("a").agg(F.ceil(F.count("*") / s.node).cast("int").alias("parts"))
    leaders = parts.join(sets.select(F.col("digest").alias("a"), F.col("words").alias("x")), "a")
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    members = stars.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    members = members.join(sets.select(F.col("digest").alias("b"), F.col("words").alias("y")), "b")
    return members.join(leaders, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _left_over(large: DataFrame, sets: DataFrame, s: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """Links of members of large nodes (path, digest, size, n, shingles) with
    their node's leaders, and the members with ``left``: whether these links
    do not connect it to what most leaders are in."""
    lowest = [F.min(F.struct(F.xxhash64(F.lit(i), "digest"), "digest"))["digest"] for i in range(s.leaders)]
    leaders = large.groupBy("path").agg(F.array(*lowest).alias("all")).select("path", F.posexplode("all").alias("i", "leader"))
    tried = materialise(large.join(leaders, "path").select("path", "digest", "i", "leader"), "tried")
    stars = materialise(tried.select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct().where("a != b"), "stars")
    links = materialise(_confirmed(stars, sets, s), "links")
    found = links.select(F.col("a").alias("leader"), F.col("b").alias("digest"), F.lit(True).alias("near"))
    bit = F.when(F.col("near") | (F.col("leader") == F.col("digest")), F.expr("shiftleft(1, i)")).otherwise(0)
    first = F.min(F.when(bit > 0, F.struct("i", "leader")))["leader"]
    masks = tried.join(found, ["leader", "digest"], "left").groupBy("path", "digest").agg(F.bit_or(bit).alias("mask"), first.alias("first"))
    masks = materialise(masks, "masks")

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaders that members' masks join to most others."""
        for batch in batches:
            out = []
            for seen in batch.column(1).to_pylist():
                parts: list[int] = []
                for mask in filter(None, seen):
                    apart = [x for x in parts if not x & mask]
                    parts = [*apart, reduce(int.__or__, [x for x in parts if x & mask], mask)]
                out.append(max(parts, key=lambda x: (x.bit_count(), x), default=0))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.int32())], ["path", "main"])

    main = masks.groupBy("path").agg(F.collect_set("mask").alias("seen")).mapInArrow(connected, "path long, main int")  # 2 ** leaders at most
    main = materialise(main, "main")
    left = masks.join(main, "path").select("path", "digest", (F.col("mask").bitwiseAND(F.col("main")) == 0).alias("left"))
    # one link connects a member, and one each the leaders that members join
    joined = leaders.join(main, "path").where(F.expr("(shiftleft(1, i) & main) != 0"))
    joined = joined.groupBy("path").agg(F.min(F.struct("i", "leader"))["leader"].alias("a"), F.collect_set("leader").alias("all"))
    joined = joined.select("a", F.explode("all").alias("b"))
    links = masks.select(F.col("first").alias("a"), F.col("digest").alias("b")).unionByName(joined).where("a != b").distinct()
    return materialise(links, "links"), materialise(large.join(left, ["path", "digest"]), "left")


def _counts(sets: list[np.ndarray], first: int, width: int = 4096) -> np.ndarray:
    """Intersection sizes of all sets up to ``first`` with all from there on
    (all with all for 0), by products of blocks of the incidence matrix."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = slice(0, first or len(sets))
    out = np.zeros((first or len(sets), len(sets) - first), np.float32)
    for at in range(0, len(shared), width):
        x, y = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), min(width, len(shared) - at)), np.float32)
        block[owner[x:y], column[x:y] - at] = 1
        out += block[left] @ block[first:].T
    return out


def _linked_groups(members: list[bytes], sets: list[np.ndarray], s: NearDuplicates, other: int = 0) -> list[tuple[bytes, bytes]]:
    """Links that connect what all pairs of a node's members connect: with
    ``other``, pairs of a member before that place and one from it on."""
    both = _counts(sets, other)
    sizes = np.array([len(x) for x in sets], np.float64)
    union = sizes[: other or None, None] + sizes[None, other:] - both
    near = 100 * both.astype(np.float64) >= s.percent * union
    label = np.arange(len(members))
    while True:
        row, col = label[: other or None], label[other:]
        low = np.where(near, col[None, :], len(members)).min(axis=1, initial=len(members))
        high = np.where(near, row[:, None], len(members)).min(axis=0, initial=len(members))
        new = label.copy()
        new[: other or None] = np.minimum(new[: other or None], low)
        new[other:] = np.minimum(new[other:], high)
        new = new[new]
        if np.array_equal(new, label):
            return [(members[x], members[i]) for i, x in enumerate(label.tolist()) if x != i]
        label = new


def _exhaustive(rows: DataFrame, s: NearDuplicates, key: list[str]) -> DataFrame:
    """Links within groups of rows (key, side, digest, words)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("digest", "ascending")])
        side = group["side"].to_pylist()
        found = _linked_groups(
            group["digest"].to_pylist(), [np.frombuffer(x, np.uint64) for x in group["words"].to_pylist()], s,
            side.index(1) if 1 in side and 0 in side else 0,
        )
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.groupBy(*key).applyInArrow(run, "a binary, b binary")


def _deeper(rows: DataFrame, s: NearDuplicates, salt: int) -> DataFrame:
    """Large nodes (path, digest, short) branched further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            short = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            start = batch.column(0).to_numpy().view(np.uint64)
            row, path = s.paths(short, start, salt)
            own = [batch.column(i).take(pa.array(row)) for i in (1, 3, 4)]
            yield pa.record_batch([pa.array(path.view(np.int64)), *own], ["path", "digest", "size", "left"])

    return rows.select("path", "digest", "short", "size", "left").mapInArrow(run, "path long, digest binary, size long, left boolean").distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", settings: NearDuplicates | None = None
) -> DataFrame:
    """Component of each document: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and link
    with nothing; their component is their own id.  Ids may repeat: each row
    is judged by its own text, and ``kept`` is true where its id is its
    component's smallest.  Null ids take part and are never the smallest.  An
    empty table gives no rows; other columns are ignored.
    """
    s = settings or NearDuplicates()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches, by_class = _classes(docs, s)
    smallest = materialise(by_class.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    by_class = by_class.join(smallest, "label").select("digest", "component_id")
    found = sketches.where("digest IS NOT NULL").join(by_class, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _classes(docs: DataFrame, s: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (digest, rep, label) of each distinct set: its
    smallest id, and the same label for all sets that links connect."""
    sketches = materialise(_sketches(docs, s), "sketches")
    classes = sketches.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("short").alias("short"), F.first("paths").alias("paths")
    )
    classes = materialise(classes, "classes")
    links = _links(docs, classes, s)
    by_class = classes.select("digest", "rep", F.col("digest").alias("label"))
    if links is not None:
        labels = components(links)
        by_class = classes.join(labels, classes.digest == labels.node, "left")
        by_class = by_class.select("digest", "rep", F.coalesce("label", "digest").alias("label"))
    return sketches, materialise(by_class, "by-class")


def _links(docs: DataFrame, classes: DataFrame, s: NearDuplicates) -> DataFrame | None:
    """Links (a, b) of digests that connect each component.

    Nodes of up to ``s.node`` members and ``s.shingles`` shingles are compared
    exhaustively at once.  In larger ones every member is tried with some
    leaders; those that this leaves over are compared with all members, or,
    where they are many, the node is branched deeper.
    """
    nodes = classes.select(F.explode("paths").alias("path"), "digest", "size", F.lit(True).alias("left"))
    sets, links = None, []
    for salt in range(s.rounds + 1):
        sizes = nodes.groupBy("path").agg(
            F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("digest").alias("least"),
            F.sum(F.xxhash64("digest").cast("decimal(20,0)")).alias("members"), F.bool_or("left").alias("open"),
        ).where("n > 1 AND open")
        # nodes of the same members, as most trees make them, count once
        sizes = sizes.groupBy("n", "shingles", "least", "members").agg(F.min("path").alias("path")).select("path", "n", "shingles")
        nodes = materialise(nodes.drop("left").join(sizes, "path"), "nodes")
        if nodes.isEmpty():
            break
        if sets is None:
            wanted = nodes.select("digest").distinct().join(classes.select("digest", "rep"), "digest")
            sets = materialise(_full_sets(docs, materialise(wanted, "wanted"), s), "sets")
        is_small = (F.col("n") <= s.node) & (F.col("shingles") <= s.shingles)
        small = nodes.where(is_small).select("path", F.lit(0).alias("side"), "digest").join(sets, "digest")
        links.append(materialise(_exhaustive(small, s, ["path"]), "links"))
        large = materialise(nodes.where(~is_small), "large")
        if large.isEmpty():
            break
        found, large = _left_over(large, sets, s)
        links.append(found)
        rest = large.where("left").groupBy("path").agg(F.count("*").alias("n_left"), F.sum("size").alias("size_left"))
        large = materialise(large.join(rest, "path"), "large")  # nodes that leaders connect are done
        few = (F.col("n_left") <= s.node) & (F.col("size_left") <= s.shingles)
        links.append(materialise(_with_all(large.where(few), sets, s), "links"))
        large = large.where(~few).drop("n_left", "size_left")
        if large.isEmpty():
            break
        if salt == s.rounds:
            links.append(materialise(_blocks(large.drop("left"), sets, s), "links"))
            break
        nodes = materialise(_deeper(large.drop("n", "shingles").join(classes.select("digest", "short"), "digest"), s, salt + 1), "deeper")
    return reduce(DataFrame.unionByName, links) if links else None


def _with_all(large: DataFrame, sets: DataFrame, s: NearDuplicates) -> DataFrame:
    """Links of the few members left over with all members of their node,
    of which each task holds a block."""
    n_blocks = F.greatest(F.ceil(F.col("n") / s.node), F.ceil(F.col("shingles") / s.shingles)).cast("int")
    rows = large.withColumn("parts", n_blocks)
    members = rows.select("path", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("block"), F.lit(1).alias("side"), "digest")
    left = rows.where("left").select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(0).alias("side"), "digest")
    return _exhaustive(members.unionByName(left).join(sets, "digest"), s, ["path", "block"])


def _blocks(large: DataFrame, sets: DataFrame, s: NearDuplicates) -> DataFrame:
    """All pairs of blocks of those nodes that branching never split: each
    task holds two blocks of a node, of half the members and shingles each
    that a small node may have."""
    n_blocks = F.greatest(F.ceil(2 * F.col("n") / s.node), F.ceil(2 * F.col("shingles") / s.shingles)).cast("int")
    own = large.withColumn("parts", n_blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")),
    )
    own = own.withColumn("pair", F.explode(pair)).withColumn("side", F.when((F.col("pair.x") != F.col("pair.y")) & (F.col("block") == F.col("pair.y")), 1).otherwise(0))
    own = own.select("path", "pair.x", "pair.y", "side", "digest").join(sets, "digest")
    return _exhaustive(own, s, ["path", "x", "y"])


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", settings: NearDuplicates | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns kept, without near-duplicates.

    Of each component one row stays: the smallest id's, of the first set if
    that id has several, and once if it is repeated; null ids come last.  Null
    and empty texts, and texts without words, all stay.  An empty table stays
    empty.  Columns of any name are allowed: rows travel as one struct.
    """
    s = settings or NearDuplicates()
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"))
    at = docs.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField("digest", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.record_batch([batch.column(0).field(at), *batch.columns], ["text", "row", "id"])
            for part in text_slices(iter([flat]), 0):
                _, _, digests = _sets(part.column(0), s.width)
                yield pa.record_batch([part.column(1), part.column(2), pa.array(digests, pa.binary())], schema.names)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches, by_class = _classes(plain, s)
    first = by_class.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "digest")).alias("x"))
    stay = materialise(first.select(F.col("x.rep").alias("__id"), F.col("x.digest").alias("__digest")), "stay")
    few = F.broadcast if stay.count() <= s.broadcast_rows else lambda df: df  # 24 bytes each
    known = rows.mapInArrow(run, schema)
    same = known["id"].eqNullSafe(F.col("__id")) & (known["digest"] == F.col("__digest"))
    kept = known.where("digest IS NULL").select("row.*")
    # most ids are of one row; those of several with one text go another way
    often = sketches.where("digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1")
    chosen = (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("digest") == F.col("__digest"))
    often = materialise(often.join(stay, chosen).select("__id", "__digest"), "often")
    if often.isEmpty():
        return kept.unionByName(known.join(few(stay), same).select("row.*"))
    once = stay.join(often.select(F.col("__digest").alias("d")), F.col("__digest") == F.col("d"), "left_anti")
    kept = kept.unionByName(known.join(few(once), same).select("row.*"))
    return kept.unionByName(known.join(few(often), same).dropDuplicates(["digest"]).select("row.*"))
