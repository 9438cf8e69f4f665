import hashlib
import io
import zlib

import numpy as np
import pytest

from deckloom.llm import media


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4 9 1\n" + bytes([0b10000000, 0b10000000])).tolist() == [[0, *[255] * 7, 0]]
    assert media.decode(b"P2 2 1 15\n3 15\n").tolist() == [[3, 15]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 2 1 255\n\x0a\x20").tolist() == [[10, 32]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]


@pytest.mark.parametrize("bad", [b"", b"P5", b"P5 0 1 255\n", b"P5 2 2 255\nab", b"BM", b"GIF89a", b"P2 1 1 9\n12"])
def test_unreadable(bad):
    with pytest.raises(media.MediaError):
        media.decode(bad)


def test_round_trips_and_resize():
    rng = np.random.default_rng(4)
    grey = rng.integers(0, 256, (13, 7), np.uint8)
    assert np.array_equal(media.decode(media.encode_pgm(grey)), grey) and np.array_equal(media.decode(media.encode_bmp(grey)), grey)
    assert np.allclose(media.area_resize(grey, 13, 7), grey) and np.allclose(media.area_resize(grey, 1, 1), grey.mean())
    fine = np.kron(grey, np.ones((6, 4)))
    assert np.allclose(media.area_resize(grey, 6, 4), fine.reshape(6, 13, 4, 7).mean(axis=(1, 3)))
    tiles = media.npy_tiles(grey, 5)
    assert [(y, x) for y, x, _ in tiles] == [(y, x) for y in (0, 5, 10) for x in (0, 5)]
    assert np.array_equal(np.load(io.BytesIO(tiles[1][2])), grey[:5, 5:])


def test_tiles_operator(spark):
    grey = np.arange(64, dtype=np.uint8).reshape(8, 8)
    rows = [(1, media.encode_pgm(grey)), (2, None), (3, b"x"), (1, media.encode_bmp(grey))]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "id long, content binary, error string")
    got = media.media_tiles(frame, media_id="id", content="content", size=(4, 4), tile=2).collect()
    assert len(got) == 10 and sum(r["error"] is not None for r in got) == 2
    assert len({r["dhash"] for r in got if r["media_id"] == 1}) == 1


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_texts_are_stored_whole(spark, odd_documents, no_documents, form):
    rows = media.text_media(odd_documents, form=form).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        data_padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(data_padded))
        if len(data_padded) <= 64 * 64:  # by plain means over a grid that both sizes divide
            grey = np.frombuffer(data_padded, np.uint8).reshape(-1, 64).astype(float)
            fine = np.kron(grey, np.ones((16, 9)))
            means = fine.reshape(16, len(grey), 16, 36).mean(axis=(1, 3))
            small = np.block([[np.load(io.BytesIO(t["npy"])) for t in r["tiles"][i : i + 2]] for i in (0, 2)])
            assert [(t["top"], t["left"]) for t in r["tiles"]] == [(0, 0), (0, 8), (8, 0), (8, 8)] and np.abs(small - means).max() <= 0.5 + 1e-6
            bits = np.round(fine.reshape(8, 2 * len(grey), 9, 64).mean(axis=(1, 3)), 6)
            assert r["feature"] == np.packbits(bits[:, :-1] < bits[:, 1:]).tobytes().hex()
        assert r["payload_sha256"] == hashlib.sha256(data_padded).hexdigest() and r["tail_crc32"] == zlib.crc32(data_padded[-64:])
    same = [r for r in rows if r["doc_id"] in (1, 6)]
    assert len({str(tuple(r)[1:]) for r in same}) == 1
    assert media.text_media(no_documents).count() == 0
