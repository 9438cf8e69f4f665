import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom import ConvertOptions, ParseError, convert, convert_files, get_describer
from deckloom.api import to_markdown
from deckloom.operators.complexity import complexity_scores
from deckloom.operators.enrich import description_metrics, enrich_descriptions, reconstruct_slides, reconstruction_metrics
from deckloom.providers import ImageDescriber, SlideReconstructor
from deckloom.sources import convert as office
from deckloom.sources import pixels
from deckloom.sources.decks import DeckDataSource, parse_files, read_decks, split_records
from deckloom.sources.ooxml import Package, records
from deckloom.sources.writer import SlideXml, write_deck
from deckloom.streaming.decks import convert_stream

INCH = 914_400


def at(left, top, width=2, height=1):
    return tuple(int(x * INCH) for x in (left, top, width, height))


def png(pixels_: np.ndarray) -> bytes:
    height, width = pixels_.shape[:2]
    kind = {3: 2, 4: 6}[pixels_.shape[2]]
    rows = b"".join(b"\0" + r.tobytes() for r in pixels_.astype(np.uint8))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def routing_deck() -> bytes:
    columns = SlideXml().text([("4열 매핑", 0)], at(0.3, 0.2, 9))
    for i, label in enumerate(["기획", "설계", "개발", "운영"]):
        columns.text([(label, 0)], at(0.3 + i * 2.2, 1.5))
    flow = SlideXml().text([("AS-IS -> TO-BE", 0)], at(0.3, 0.2, 9))
    for label, left in (("AS-IS", 0.3), ("중간 처리", 4), ("TO-BE", 7.5)):
        flow.text([(label, 0)], at(left, 2))
    flow.connector(at(2.3, 2.5)).connector(at(6, 2.5))
    chart = SlideXml().text([("KPI 대시보드", 0)], at(0.3, 0.2, 9)).chart("카테고리 비중", ["A", "B", "C"], "Share", at(1, 1.5))
    plain = SlideXml().text([("요약", 0)], placeholder="title").text([("첫째 항목", 0), ("둘째 항목", 0)], placeholder="body", index=1)
    return write_deck([columns, flow, chart, plain])


def parsed(spark, data, **options):
    return split_records(parse_files(spark.createDataFrame([("d", bytearray(data))], "path string, content binary"), **options))


def test_shapes_of_a_deck():
    inner = SlideXml().text([("leaf", 0)]).table([["A", "B"], ["C\nD", "E"]]).image(b"img", "jpg")
    slide = SlideXml(notes="note 1\nnote 2").text([("Title", 0)], at(1, 2), placeholder="ctrTitle").text([("a\x0bb", 1), ("", 0)])
    slide.group(inner).chart("Sales Chart", ["Q1", "Q2", "Q1"], "Revenue").diagram(["Node Alpha", " Node Beta "]).text([("3", 0)], placeholder="sldNum", index=9)
    rows = list(records("d", "p", write_deck([slide, SlideXml()])))
    assert [r["record"] for r in rows].count("slide") == 2 and rows[0]["slide_width_emu"] == 9_144_000
    assert (rows[1]["title"], rows[1]["notes"]) == ("Title", "note 1\nnote 2")
    shapes = [r for r in rows if r["record"] == "shape"]
    assert [(r["path"], r["kind"]) for r in shapes] == [
        ([0], "text"), ([1], "text"), ([2], "group"), ([2, 0], "text"), ([2, 1], "table"), ([2, 2], "image"), ([3], "other"), ([4], "other"), ([5], "text"),
    ]
    title, body, _, _, table, image, chart, diagram, footer = shapes
    assert title["is_title"] and (title["left"], title["top"]) == (INCH, 2 * INCH) and footer["is_footer"]
    assert body["paragraphs"] == [{"text": "ab", "level": 1}, {"text": "", "level": 0}]  # breaks count in frames, not in joined runs
    assert (table["rows"], table["n_rows"], table["n_cols"]) == ([["A", "B"], ["C\nD", "E"]], 2, 2)
    assert (image["image_bytes"], image["image_format"], image["image_ext"], image["alt_text"]) == (b"img", "jpeg", "jpg", "")
    assert (chart["mso_shape_type"], chart["fallback_text"]) == ("CHART", "Sales Chart Revenue Q1 Q2")
    assert (diagram["mso_shape_type"], diagram["fallback_text"]) == ("DIAGRAM", "Node Alpha Node Beta")


@pytest.mark.parametrize("data", [b"", b"not a zip", write_deck([])[:40]])
def test_no_decks(data):
    with pytest.raises(ParseError):
        Package(data)


def test_permissive_and_failfast(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(routing_deck())
    (tmp_path / "b.pptx").write_bytes(b"junk")
    deck = read_decks(spark, str(tmp_path))
    assert deck.slides.count() == 4 and [r["error"][:10] for r in deck.errors.collect()] == ["not a deck"]
    with pytest.raises(Exception, match="not a deck package"):
        read_decks(spark, str(tmp_path), mode="FAILFAST").slides.count()
    spark.dataSource.register(DeckDataSource)
    rows = spark.read.format("deck").option("path", str(tmp_path)).option("mode", "permissive").load()
    assert rows.groupBy("record").count().where("record = 'slide'").first()["count"] == 4
    assert {r["record"] for r in rows.select("record").collect()} == {"deck", "slide", "shape", "error"}


def test_conversion(spark, tmp_path):
    path = tmp_path / "a.pptx"
    path.write_bytes(routing_deck())
    text = convert(path, spark=spark, options=ConvertOptions(validate=True))
    assert text.startswith("## Slide 1\n\n4열 매핑\n\n기획\n\n설계") and text.endswith("## 요약\n\n첫째 항목\n둘째 항목")
    (tmp_path / "empty.pptx").write_bytes(write_deck([]))
    got = {r["deck_id"].rpartition("/")[2]: r["markdown"] for r in convert_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pptx": text, "empty.pptx": ""}
    with pytest.raises(ParseError):
        convert(tmp_path / "none.pptx", spark=spark)
    (tmp_path / "bad.pptx").write_bytes(b"x")
    with pytest.raises(ParseError):
        convert(tmp_path / "bad.pptx", spark=spark)


class Rebuild:
    def reconstruct(self, image_bytes, image_ext, context):
        if image_bytes == b"bad":
            raise RuntimeError("no")
        i = context.slide_index
        return f"### 구조화 재구성 (slide {i})\n\n| 항목 | 값 |\n| --- | --- |\n| 신호 | slide-{i} |\n"


def test_routing_and_reconstruction(spark):
    deck = parsed(spark, routing_deck())
    assert {r["slide_index"]: r["score"] for r in complexity_scores(deck.slides, deck.shapes).collect()} == {0: 4, 1: 8, 2: 4, 3: 0}
    renderer = lambda path, indices, dpi=150: {i: f"png {i}".encode() for i in indices}
    options = ConvertOptions(visual_reconstruct=True, reconstructor=Rebuild(), renderer=renderer, force_render=frozenset({0, 1, 2}), force_text=frozenset({3}))
    part = "## Slide {n}\n\n### 구조화 재구성 (slide {i})\n\n| 항목 | 값 |\n| --- | --- |\n| 신호 | slide-{i} |\n\n\n---\n\n"
    want = "".join(part.format(n=i + 1, i=i) for i in range(3)) + "## 요약\n\n첫째 항목\n둘째 항목"
    assert to_markdown(deck, options).first()["markdown"] == want
    before, after = deck.slides, reconstruct_slides(deck.decks, deck.slides, deck.shapes, Rebuild(), renderer=renderer, max_slides=2, max_workers=9)
    routed = complexity_scores(deck.slides, deck.shapes).where("is_complex")
    assert reconstruction_metrics(routed, before, after).first()[:] == ("d", 3, 2, 1)
    failing = lambda path, indices, dpi=150: {0: None, 1: b"bad", 2: b"same"}
    text = to_markdown(deck, ConvertOptions(visual_reconstruct=True, reconstructor=Rebuild(), renderer=failing, embed_rendered_image=True)).first()["markdown"]
    assert text.count("구조화") == 1 and "data:image/png;base64,c2FtZQ==" in text and "AS-IS" in text


class Count:
    def describe(self, image_bytes, image_ext, shape_hint):
        if image_bytes == b"bad":
            raise RuntimeError("no")
        return f"{image_ext}:{bytes(image_bytes).decode()}:{shape_hint}"


def test_descriptions(spark):
    first = SlideXml().image(b"one", "png").image(b"bad", "gif").image(b"", "png")
    deck = parsed(spark, write_deck([first, SlideXml().group(SlideXml().image(b"one", "jpg"))]))
    assert enrich_descriptions(deck.shapes, None) is deck.shapes
    done = enrich_descriptions(deck.shapes, Count(), max_workers=2).where("kind = 'image'").orderBy("slide_index", "path").collect()
    assert [r["description"] for r in done] == ["png:one:None", None, None, "png:one:None"]
    assert description_metrics(deck.shapes).select("images", "calls", "cache_hits").first()[:] == (3, 2, 1)
    assert isinstance(Count(), ImageDescriber) and isinstance(Rebuild(), SlideReconstructor) and not isinstance(Rebuild(), ImageDescriber)


def test_providers():
    with pytest.raises(ValueError):
        get_describer("nobody")


def synthetic(kind):
    if kind == "photo":
        rng = np.random.default_rng(42)
        y, x = np.mgrid[0:200, 0:200]
        base = np.stack([255 * x / 200, 255 * y / 200, 255 * (x + y) / 400], axis=2)
        return np.minimum(255, base + rng.integers(0, 21, base.shape))
    if kind == "logo":
        image = np.full((64, 64, 4), 255)
        image[..., 3] = 0
        image[16:48, 16:48] = (50, 120, 200, 255)
        return image
    image = np.full((256, 256, 3), 255)
    if kind == "diagram":
        image[::20] = image[:, ::20] = 30
        image[128:236, 30:80] = image[85:236, 100:150] = (70, 130, 180)
    else:
        for i in range(12):
            top = i * 18 + 4
            columns = [x for x in range(10, 246) if x % 42 not in range(38, 42)]
            image[top : top + 9, columns] = 10
    return image


@pytest.mark.parametrize("kind", ["photo", "logo", "diagram", "text"])
def test_image_classes(spark, kind):
    deck = parsed(spark, write_deck([SlideXml().image(png(synthetic(kind))).image(b"junk")]), classify=True)
    rows = deck.shapes.orderBy("path").collect()
    assert [r["classification"] for r in rows] == [kind, None]
    tables = parsed(spark, write_deck([SlideXml().image(png(synthetic(kind)))]))
    assert pixels.classify_images(tables.shapes).first()["classification"] == kind


def test_features_against_plain_loops():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (9, 7, 3)) // 60 * 60
    got = pixels.features(png(image))
    flat = [tuple(p) for row in image.tolist() for p in row]
    luma = lambda p: (p[0] * 299 + p[1] * 587 + p[2] * 114) // 1000
    edges = 0
    for y in range(9):
        for x in range(7):
            near = [image[y][x + 1]] if x < 6 else []
            near += [image[y + 1][x]] if y < 8 else []
            edges += any(abs(luma(image[y][x].tolist()) - luma(n.tolist())) >= 30 for n in near)
    assert got["edge_density"] == edges / 63 and got["n_unique_colors"] == len(set(flat))
    assert got["color_fraction"] == sum(max(p) - min(p) >= 40 for p in flat) / 63
    assert got["bg_fraction"] == max(flat.count(p) for p in set(flat)) / 63
    assert pixels.features(b"") is None and pixels.features(png(image)[:60]) is None


@pytest.mark.skipif(office.office_available(), reason="the fallbacks need an absent office program")
def test_without_an_office_program():
    assert office.render_deck(b"x", [0, 1]) == {0: None, 1: None} and office.render_slide("nowhere", 3) is None
    assert office.convert_vector(b"x", "emf") is None and office.convert_vector(b"x", "png") is None and not office.render_available()


def test_stream_of_decks(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.pptx").write_bytes(write_deck([SlideXml().text([("one", 0)])]))
    run = lambda: convert_stream(spark, str(source), str(out), str(tmp_path / "check"), available_now=True).awaitTermination()
    run()
    (source / "b.pptx").write_bytes(write_deck([SlideXml().text([("two", 0)])]))
    run()
    got = spark.read.parquet(str(out))
    assert sorted(r["markdown"] for r in got.collect()) == ["## Slide 1\n\none", "## Slide 1\n\ntwo"]
    assert got.select(F.count_distinct("batch")).first()[0] == 2


def test_batches_are_validated_and_rendered_from_their_bytes(spark):
    """Files that no local path leads to: renders get the bytes."""
    from pyspark.sql import functions as F

    from deckloom import ConvertOptions
    from deckloom.api import convert_contents

    decks = [write_deck([SlideXml().text([(f"Title {i}", 0)], placeholder="title").text([("```", 0)]) for _ in range(2)]) for i in range(3)]
    files = spark.createDataFrame([(f"s3a://far/{i}.pptx", d) for i, d in enumerate(decks)], "path string, content binary")

    class Rebuild:
        def reconstruct(self, image_bytes, image_ext, context):
            return f"# {context.slide_index} of {image_bytes.decode()}"

    def renderer(deck, indices, *, dpi=150):
        return {i: f"{len(deck)} {type(deck).__name__}".encode() for i in indices}

    o = ConvertOptions(reconstructor=Rebuild(), visual_reconstruct=True, renderer=renderer, complex_when=F.col("slide_index") == 1, validate=True)
    got = {r["deck_id"]: r for r in convert_contents(files, o).collect()}
    for i, d in enumerate(decks):
        row = got[f"s3a://far/{i}.pptx"]
        assert row["markdown"].endswith(f"# 1 of {len(d)} bytes") and f"## Title {i}" in row["markdown"] and "# 0 of" not in row["markdown"]
        assert not row["valid"] and len(row["warnings"]) >= 1
    plain = convert_contents(files, ConvertOptions(validate=True))
    assert plain.columns == ["deck_id", "markdown", "valid", "warnings"] and all(r["valid"] for r in plain.collect())
    assert convert_contents(files).columns == ["deck_id", "markdown"]


def test_classes_are_found_where_images_are(spark):
    """Other shapes, images without bytes and unreadable ones keep their class."""
    from pyspark.sql import functions as F

    from deckloom.plans.views import as_shapes
    from deckloom.sources.pixels import classify_images

    rows = [(0, "text", None, "a"), (1, "image", None, "b"), (2, "image", b"x", "c"), (3, None, b"y", "d"), (4, "image", b"x", None)]
    frame = spark.createDataFrame(rows, "i int, k string, b binary, c string")
    shapes = as_shapes(frame, deck_id=F.lit("d"), slide_index=F.col("i"), kind=F.col("k"), image_bytes=F.col("b"), classification=F.col("c"))
    got = {r["slide_index"]: r["classification"] for r in classify_images(shapes).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 3: "d", 4: None}
