import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deckloom.llm import packing
from deckloom.llm.queries import op5_packing, table, tokenizer_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_best_fit_against_a_plain_list_of_bins(lengths, open_bins):
    bins, offsets = packing.best_fit(lengths, 20, open_bins)
    free: dict[int, int] = {}
    used, n = {}, 0
    for length, own, offset in zip(lengths, bins, offsets, strict=True):
        fits = sorted(f for f in free.values() if f >= length)
        if fits:
            assert own in free and free[own] == fits[0]
        else:
            assert own == n
            n, free[own] = n + 1, 20
        assert offset == 20 - free[own] == used.get(own, 0)
        used[own] = offset + length
        free[own] -= length
        if free[own] == 0:
            del free[own]
        elif len(free) > open_bins:  # the fullest goes, the newest if it ties
            least = min(free.values())
            gone = own if free[own] == least else next(b for b in reversed(free) if free[b] == least)
            if free[own] == least or [b for b in free if free[b] == least] == [gone]:
                del free[gone]
            else:
                return  # several equally full: which one closes is not checked


def test_packing_holds_every_token(spark, sf_dir):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = op5_packing(spark, sf_dir).collect()
    ids = {i: np.array([*exact.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids[i])
        assert all(r["length"] == 1024 for r in own[1:]) and own[0]["length"] <= 1024
    assert by_doc.keys() == docs.keys()
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_bin) <= 1.03 * sum(map(len, ids.values())) / 1024 + 1


@pytest.mark.parametrize(
    "text", ["<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "  a\n\n b \n", "it's  don't x", "日本 1234é", "\x1c \x85", ""]
)
def test_same_ids_as_tokenizers(text):
    from tokenizers import Tokenizer

    bpe = packing.ByteBpe(tokenizer_path())
    want = np.array(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert bpe._quick is not None and bpe.ids(text) == bpe.exact(text) == want
    assert (50256 in np.frombuffer(want, "<u4")) == ("<|endoftext|>" in text)


def test_rows_alike_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 4000, "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path(), group=500).collect()
    groups = [r["sequence_id"] >> 32 for r in rows]
    assert len(rows) == 4000 and len(set(groups)) == 8 and max(groups.count(g) for g in set(groups)) < 1000


def test_odd_rows(spark, odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, tokenizer_path(), group=4).collect()
    first = [r for r in rows if r["piece"] == 0]
    assert len(first) == odd_documents.count()
    assert {r["length"] for r in first if r["doc_id"] in (2, 3)} == {1}
    assert packing.pack_documents(no_documents, tokenizer_path()).count() == 0
