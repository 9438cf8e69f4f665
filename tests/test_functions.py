import base64
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckloom.functions import headings, images, tables, text
from deckloom.operators.validate import heading_level, is_separator_row, row_cells
from helpers import plain_cells

ODD = st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x1d\x85\xa0　  ab#>|\\-:`é", max_size=16)
SOME = st.lists(ODD, min_size=1, max_size=30)
QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def apply(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", column.alias("y")).orderBy("i").collect()]


@QUICK
@given(SOME)
def test_white_space_and_lines(spark, values):
    assert apply(spark, values, text.strip(F.col("x"))) == [v.strip() for v in values]
    assert apply(spark, values, text.rstrip(F.col("x"))) == [v.rstrip() for v in values]
    assert apply(spark, values, text.split_lines(F.col("x"))) == [v.splitlines() for v in values]


@QUICK
@given(SOME)
def test_normalisation_headings_and_cells(spark, values):
    normal = [re.sub(r"[ \t]{2,}", " ", v.replace("\x0b", "\n")) for v in values]
    assert apply(spark, values, text.normalize_text(F.col("x"))) == normal
    assert apply(spark, values, text.collapse_blank_lines(F.col("x"))) == [re.sub(r"\n{3,}", "\n\n", v) for v in values]
    assert apply(spark, values, headings.heading_path(F.col("x"))) == [[p.strip() for p in v.split(">") if p.strip()] for v in values]
    levels = [len(m[1]) if (m := re.match(r"(#{1,6})(?: |\Z)", v)) else None for v in values]
    assert apply(spark, values, heading_level(F.col("x"))) == levels
    assert apply(spark, values, row_cells(F.col("x"))) == [plain_cells(v) for v in values]
    rules = [bool(c := plain_cells(v)) and all(re.match(r"^:?-{1,}:?\Z", x.strip()) for x in c) for v in values]
    assert apply(spark, values, is_separator_row(F.col("x"))) == rules


def test_heading_lines(spark):
    titles = ["A > B > C", "one", " > x > ", "a>b>c>d>e>f>g", ""]
    got = apply(spark, titles, headings.heading_lines(F.col("x"), hierarchy=True))
    assert got == [
        ["## A", "### B", "#### C"], ["## one"], ["##  > x > "], ["## a", "### b", "#### c", "##### d", "###### e", "###### f", "###### g"], ["## "],
    ]
    assert apply(spark, titles, headings.heading_lines(F.col("x")))[0] == ["## A > B > C"]
    assert apply(spark, [["### x", "## y ", "## z"], []], headings.section_of(F.col("x")), "array<string>") == ["y", ""]


def test_notes_frontmatter_and_comment(spark):
    assert apply(spark, ["", " \x0b", "a\x0bb\nc"], headings.notes_block(F.col("x"))) == ["", "", "> notes\n> a\n> b\n> c"]
    assert apply(spark, ["a\n| b"], headings.slide_comment(F.lit(3), F.col("x"), F.lit(True))) == ["<!-- slide_index: 3 | section: a / b | has_diagram: true -->"]
    assert apply(spark, ["x"], headings.frontmatter(F.lit(2), "100% me")) == ["---\ngenerator: 100% me\nslide_count: 2\n---"]


def test_masking(spark):
    said = ["a@b.co, 010-1234-5678", "02.123.4567 x", "010　1234　5678", "no $1 \\ here", "0123-4567"]
    on = text.MaskingOptions(enabled=True)
    assert apply(spark, said, text.mask_text(F.col("x"), on)) == ["[REDACTED], [REDACTED]", "[REDACTED] x", "[REDACTED]", "no $1 \\ here", "0123-4567"]
    assert apply(spark, said, text.mask_text(F.col("x"), text.MaskingOptions())) == said
    assert apply(spark, said[:1], text.mask_text(F.col("x"), text.MaskingOptions(True, ("b", r"\d")))) == ["a@[REDACTED].co, " + "-".join("[REDACTED]" * n for n in (3, 4, 4))]


TABLE = "array<array<string>>"


def test_tables(spark):
    rows = [["h|1", "h\n2"], ["a\x0bb"], ["1", "2", "3"]]
    assert apply(spark, [rows], tables.gfm_table(F.col("x")), TABLE) == ["| h\\|1 | h<br>2 |\n| --- | --- |\n| a<br>b |  |\n| 1 | 2 |"]
    assert apply(spark, [rows], tables.mermaid_table(F.col("x"), F.lit(3), F.lit(2)), TABLE) == [
        "```mermaid\n%% table: 3x2\n%% headers: h|1 | h 2\n%% row 1: a b\n%% row 2: 1 | 2 | 3\n```"
    ]
    assert apply(spark, [[["a"]]], tables.table_data(F.col("x"), F.lit(1), F.lit(1)), TABLE) == ["```table-data\ntable: 1x1\nheaders: a\n```"]
    assert apply(spark, [[["<&>"], ["b"]]], tables.html_table(F.col("x")), TABLE) == [
        "<table>\n  <tr>\n    <th>&lt;&amp;&gt;</th>\n  </tr>\n  <tr>\n    <td>b</td>\n  </tr>\n</table>"
    ]
    with pytest.raises(ValueError):
        tables.table_markdown(F.col("x"), F.lit(1), F.lit(1), "csv")


def test_table_flags(spark):
    cases = [[], [[]], [[" ", "\t"]], [["a", "a "]], [["", ""], ["x", "y"]], [["a", "b"], ["a", "b"]]]
    assert apply(spark, cases, tables.is_blank_table(F.col("x")), TABLE) == [True, True, True, False, False, False]
    assert apply(spark, cases, tables.has_repeated_cells(F.col("x")), TABLE) == [False, False, False, True, False, False]
    size = lambda n, m: apply(spark, [[["x"]]], tables.is_complex_table(F.col("x"), F.lit(n), F.lit(m)), TABLE)[0]
    assert [size(25, 2), size(26, 2), size(1, 8), size(1, 9)] == [False, True, False, True]
    blank = tables.table_markdown(F.col("x"), F.lit(9), F.lit(9))
    assert apply(spark, [None, [], [[" "]]], blank, TABLE) == ["", "", ""]


@pytest.mark.parametrize("said, want", [
    ("no fence", None), ("```mermaid\n\n```", None), ("```mermaid\npie\n```", None), ("```mermaid\nflowchartX\n```", None),
    ("x ```MERMAID  \n\n  Graph TD \n A-->B  \n\n\n``` y\n```mermaid\nflowchart\n```", "```mermaid\n  Graph TD\n A-->B\n```"),
    ("```mermaid\nflowchart TD\n\nA\n```", "```mermaid\nflowchart TD\n\nA\n```"),
])
def test_flowchart(spark, said, want):
    assert apply(spark, [said], text.flowchart_fence(F.col("x"))) == [want]


def test_paragraphs(spark):
    given_ = [[("a  b\x0bc", 0), ("d", 2), ("", 0), ("", 0), ("", 0), ("e", 1)], [("", 0)], [("", 0), ("", 0)], []]
    got = apply(spark, [[{"text": t, "level": n} for t, n in x] for x in given_], text.paragraphs_markdown(F.col("x")), "array<struct<text:string,level:int>>")
    assert got == ["a b\nc\n    - d\n\n  - e", "", "\n", ""]


def test_images(spark):
    marker = lambda d, a, c: apply(spark, ["x"], images.image_markdown(F.lit(d), F.lit(a), F.lit(c), F.lit(2), F.lit(1)))[0]
    assert marker("", "alt", None) == "" and marker("d", "", "logo") == "d\n\n_[logo image]_"
    assert marker(None, "alt", "logo") == "![alt](...)"
    assert marker(None, "", "diagram") == "![슬라이드 2 이미지 1 — diagram]" and marker(None, None, None) == "![슬라이드 2 이미지 1]"
    png = bytes(range(200))
    assert apply(spark, [bytearray(png)], text.data_url(F.col("x")), "binary") == [f"![slide render](data:image/png;base64,{base64.b64encode(png).decode()})\n\n"]
    assert apply(spark, ["photo", None], images.shape_hint(F.col("x"))) == [images.HINTS["photo"], None]
    assert apply(spark, ["diagram"], images.shape_hint(F.col("x"), diagram_mermaid=True))[0].endswith(images.DIAGRAM_HINT_SUFFIX)
    assert apply(spark, ["PNG", "jpg", "tiff"], images.media_type(F.col("x"))) == ["image/png", "image/jpeg", "image/png"]
