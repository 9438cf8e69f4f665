import random

import pytest

from deckloom.functions.text import MaskingOptions
from deckloom.operators.assemble import assemble_documents, suppress_repeated_labels
from deckloom.operators.complexity import complexity_scores, route_slides
from deckloom.operators.render import assemble_slides
from helpers import frames, shape, slide

SLIDES = [slide(0, "표지"), slide(1, "A > B > C", "발표자 노트: 핵심 논지를 강조할 것"), slide(2, "마무리")]
SHAPES = [
    shape(1, [0], "text", lines=[("핵심 내용 설명입니다.", 0)]),
    shape(1, [1], "table", rows=[["항목", "값"], ["속도", "빠름"]]),
    shape(1, [2], "image", classification="diagram"),
    shape(2, [0], "text", lines=[("감사합니다.", 0)]),
]
BODY = "핵심 내용 설명입니다.\n\n| 항목 | 값 |\n| --- | --- |\n| 속도 | 빠름 |\n\n![슬라이드 2 이미지 1 — diagram]"
PLAIN = f"## 표지\n\n---\n\n## A > B > C\n\n{BODY}\n\n---\n\n## 마무리\n\n감사합니다."
FULL = (
    "---\ngenerator: g\nslide_count: 3\n---\n\n<!-- slide_index: 1 | section: 표지 | has_diagram: false -->\n## 표지\n\n---\n\n"
    f"<!-- slide_index: 2 | section: A | has_diagram: true -->\n## A\n\n### B\n\n#### C\n\n{BODY}\n\n> notes\n> 발표자 노트: 핵심 논지를 강조할 것\n\n---\n\n"
    "<!-- slide_index: 3 | section: 마무리 | has_diagram: false -->\n## 마무리\n\n감사합니다."
)


@pytest.mark.parametrize("seed", range(3))
def test_whole_documents_in_any_row_order(spark, seed):
    rng = random.Random(seed)
    tables = frames(spark, rng.sample(SLIDES, 3), rng.sample(SHAPES, 4))
    tables = [t.repartition(seed + 1) for t in tables]
    assert assemble_documents(*tables).first()["markdown"] == PLAIN
    on = assemble_documents(*tables, heading_hierarchy=True, emit_toc=True, emit_frontmatter=True, include_notes=True, generator="g")
    assert on.first()["markdown"] == FULL


def one(spark, slides, shapes, **options):
    return assemble_documents(*frames(spark, slides, shapes), **options).first()["markdown"]


def test_title_shapes(spark):
    title = lambda path, t: shape(0, path, "text", lines=[(t, 0)], is_title=True)
    assert one(spark, [slide(0, "T")], [title([0], " T "), title([1], "T")]) == "## T\n\nT"
    assert one(spark, [slide(0, "T")], [title([0], "other")]) == "## T\n\nother"
    assert one(spark, [slide(0)], [title([0], " "), title([1], " First ")]) == "## First\n\n "
    assert one(spark, [slide(0)], [title([0, 0], "in a group"), shape(0, [0], "group")]) == "## Slide 1\n\nin a group"
    assert one(spark, [slide(0, " ")], []) == "##  "


def test_reading_order_groups_and_footers(spark):
    shapes = [
        shape(0, [0], "text", lines=[("low", 0)], top=2_000_000), shape(0, [1], "text", lines=[("right", 0)], left=500, top=900_000),
        shape(0, [2], "text", lines=[("left", 0)], left=5, top=100), shape(0, [3], "text", lines=[("above", 0)], top=-1),
        shape(0, [4], "group", left=100, top=0), shape(0, [4, 1], "text", lines=[("second", 0)], top=-9_000_000),
        shape(0, [4, 0], "image"), shape(0, [4, 2], "text", lines=[("page", 0)], is_footer=True), shape(0, [5], "image", left=1),
        shape(0, [6], "text", lines=[("foot", 0)], is_footer=True), shape(0, [7], "other", fallback_text=""), shape(0, [8], "text", lines=[]),
    ]
    want = "## t\n\nabove\n\n![슬라이드 1 이미지 1]\n\nleft\n\n![슬라이드 1 이미지 2]\n\nsecond\n\nright\n\nlow"
    assert one(spark, [slide(0, "t")], shapes) == want
    assert assemble_slides(*frames(spark, [slide(0, "t")], shapes)).first()["markdown"] == want


def test_reconstructed_bodies_and_masking(spark):
    shapes = [shape(0, [0], "text", lines=[("a@b.co", 0)]), shape(1, [0], "table", rows=[["a@b.co"]]), shape(1, [1], "other", fallback_text="a@b.co")]
    mask = MaskingOptions(enabled=True)
    done = one(spark, [slide(0, "x@y.zz", reconstructed_md="rebuilt a@b.co\n"), slide(1)], shapes, masking=mask)
    assert done == "## x@y.zz\n\nrebuilt [REDACTED]\n\n\n---\n\n## Slide 2\n\n| a@b.co |\n| --- |\n\n[REDACTED]"


def test_toc_and_empty_decks(spark):
    shapes = [shape(2, [0], "text", lines=[(" ", 0)])]
    slides = [slide(0, "a"), slide(1), slide(2, "c"), slide(0, deck="e")]
    got = {r["deck_id"]: r["markdown"] for r in assemble_documents(*frames(spark, slides, shapes), emit_toc=True).collect()}
    assert got == {"d": "## a\n\n---\n\n## c", "e": ""}
    decks = spark.createDataFrame([("d",), ("none",)], "deck_id string")
    got = {r["deck_id"]: r["markdown"] for r in assemble_documents(*frames(spark, slides[:1], []), decks=decks, emit_frontmatter=True, generator="g").collect()}
    assert got["none"] == "---\ngenerator: g\nslide_count: 0\n---\n\n"


def test_suppressed_labels(spark):
    blocks = ["## a\n\nX\n\nb", "## a\n\n X \n\n\nc\x0bX", "# X\nb\nd", "X"]
    frame = spark.createDataFrame([("d", i, "", b) for i, b in enumerate(blocks)] + [("d", 9, "", None)], "deck_id string, slide_index int, title string, block string")
    got = [r["block"] for r in suppress_repeated_labels(frame).orderBy("slide_index").collect()]
    assert got == [blocks[0], "## a\n\n\nc", "# X\nb\nd", "X", None]


def test_complexity_and_routing(spark):
    text = lambda i, n, left, top: shape(i, [n], "text", left=left, top=top, lines=[("t", 0)])
    shapes = [text(0, n, n * 2_000_000, 1_400_000) for n in range(4)]
    shapes += [text(1, n, n * 3_000_000, 1_900_000 + n * 100_000) for n in range(3)]
    shapes += [shape(1, [3 + n], "other", mso_shape_type="LINE") for n in range(2)]
    shapes += [shape(2, [0], "other", mso_shape_type="CHART"), text(3, 0, 0, 0), text(3, 1, 0, 5)]
    shapes += [shape(4, [0], "table", rows=[["x"]]), shape(4, [1], "group"), *[shape(4, [1, n], "other", mso_shape_type="UNKNOWN") for n in range(7)]]
    shapes += [text(5, n, n * 99_000, n * 130_000) for n in range(3)]
    slides = [slide(i) for i in range(7)]
    scored = complexity_scores(*frames(spark, slides, shapes)).cache()
    assert {r["slide_index"]: r["score"] for r in scored.collect()} == {0: 4, 1: 8, 2: 4, 3: 0, 4: 5, 5: 0, 6: 0}
    chosen = lambda **o: sorted(r["slide_index"] for r in route_slides(scored, **o).collect())
    assert chosen() == [0, 1, 2, 4] and chosen(max_slides=2) == [1, 4] and chosen(max_slides=0) == []
    assert chosen(force_render=(3, 0), force_text=(0, 1)) == [2, 3, 4] and chosen(force_render=(3,), max_slides=3) == [0, 1, 4]
