"""Token counts and bounded-space best-fit packing.

Texts become token ids in Arrow batches; the pieces' sizes, a few bytes each,
are dealt into groups by hash and each group is packed online: a fixed number
of bins stays open in a bitset keyed by free space, the piece goes where it
leaves least space, and when a new bin is needed beyond the number the fullest
closes.  Groups have a fixed expected size, so that tasks stay alike as tables
grow and a group's last open bins are a small, constant share.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class ByteBpe:
    """The ids that ``tokenizers`` gives for a file with
    ``add_special_tokens=False``: added tokens' strings in a text are those
    tokens, as the library has it.

    Where the file is a plain byte-level BPE whose ids follow its merge order,
    ``tiktoken`` computes the same ids from the same vocabulary about four
    times as fast; any other file, and a text that it fails on, goes to
    ``tokenizers``.
    """

    #: How ByteLevel pre-tokenisers split; fixed by that library.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        self._path, self._exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = self._ranks(spec)
        self._quick = None
        if ranks:
            import tiktoken

            added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
            self._quick = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Bytes of each token to its id, or None where ids don't decide."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not spec.get("normalizer")
            # tokens found as they are, wherever they stand
            and not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not plain:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens") or ()}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        last = -1
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            rank = model["vocab"][left + right]
            if rank <= last:
                return None
            last = rank
        return ranks

    def exact(self, text: str) -> bytes:
        if self._exact is None:  # a large object that most tasks never need
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self._quick is not None:
            try:
                return self._quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except BaseException as e:  # a panic of the library is no Exception
                if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit | MemoryError):
                    raise
        return self.exact(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_DEALT = PIECES + ", spread long"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = 1024
) -> DataFrame:
    """Each document's ids, then ``end_id``, cut into pieces of at most
    ``capacity``: whole ones from the end, the first takes what is left.

    Null and empty texts have one piece, ``end_id`` alone.  Null ids and
    repeated rows have pieces of their own; other columns, whatever their
    names, are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, row = ByteBpe(tokenizer_path), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                ids = tokenizer.ids(whole.as_py() or "") + end
                n = len(ids) // 4
                cut = (n - 1) % capacity + 1
                begin, piece = 0, 0
                while begin < n:
                    out.append((name, piece, begin, cut - begin, zlib.crc32(ids[4 * begin : 4 * cut]), row))
                    begin, piece, cut = cut, piece + 1, cut + capacity
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in _DEALT.split(", ")]
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _DEALT)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, packed in the given order.

    ``spaces`` has bit f set while an open bin has f free; bins of equal free
    space are stacked.  At most ``open_bins`` stay open.
    """
    spaces, n_open, n_bins = 0, 0, 0
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = [], []
    for length in lengths:
        fits = spaces >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            own = by_space[free].pop()
            if not by_space[free]:
                spaces ^= 1 << free
            n_open -= 1
        else:
            free, own = capacity, n_bins
            n_bins += 1
        bins.append(own)
        offsets.append(capacity - free)
        free -= length
        if free:
            if n_open == open_bins:  # the fullest closes first, be it this one
                fullest = (spaces & -spaces).bit_length() - 1
                if free <= fullest:
                    continue
                by_space[fullest].pop()
                if not by_space[fullest]:
                    spaces ^= 1 << fullest
                n_open -= 1
            by_space[free].append(own)
            spaces |= 1 << free
            n_open += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, n_groups: int, *, capacity: int = 1024, open_bins: int = 512) -> DataFrame:
    """Give every piece a sequence and an offset there.

    Groups are dealt by a hash of the piece and of ``spread``, its row's number
    within its part of the table, so that rows alike in all columns, however
    many, spread over the groups, and are packed in the order of a second
    hash, so sorted tables do not matter.  Reruns over the same files agree.
    """
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ["turn", *cols]])
        bins, offsets = best_fit(table["length"].to_pylist(), capacity, open_bins)
        group = table["grp"][0].as_py()
        ids = pa.array(np.array(bins, np.int64) + (group << 32))
        return pa.table([*[table[c] for c in cols], ids, pa.array(offsets, pa.int64())], [*cols, "sequence_id", "offset"])

    dealt = pieces.select(
        *cols,
        F.pmod(F.xxhash64(F.lit(1), "doc_id", "piece", "ids_crc32", "spread"), F.lit(max(1, n_groups))).alias("grp"),
        F.xxhash64(F.lit(2), "doc_id", "piece", "ids_crc32", "spread").alias("turn"),
    )
    return dealt.groupBy("grp").applyInArrow(pack, PIECES + ", sequence_id long, offset long")


#: Documents a packing group: enough that its last open bins hardly count.
GROUP = 16_384


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 2,
    capacity: int = 1024,
    open_bins: int = 512,
    group: int = GROUP,
) -> DataFrame:
    """Tokenise and pack whole documents.

    Null and empty texts are the end id alone; a text of any length is cut
    only beyond ``capacity``.  Null ids and repeated rows are packed as rows of
    their own.  Other columns are ignored; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer_path, doc_id=doc_id, text=text, end_id=end_id, capacity=capacity)
    return pack_pieces(pieces, -(-docs.count() // group), capacity=capacity, open_bins=open_bins)
