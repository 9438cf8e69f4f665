import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from deckloom import validate_markdown
from deckloom.operators import validate as v

JUMP = lambda a, b: v.HEADING_JUMP % (a, b)


@pytest.mark.parametrize("md, valid, warnings", [
    ("", False, [v.EMPTY]), (" \n\x0b", False, [v.EMPTY]), ("# a\n\ntext", True, []), ("## a\ntext", True, []),
    ("a ``` b", False, [v.UNCLOSED_FENCE]), ("```\n# x\n#### y\n```", True, []), ("### a\nb", True, [v.HEADING_START]),
    ("# a\n### b\nx\n###### c\ny", True, [JUMP(1, 3), JUMP(3, 6)]), ("# a\n\n#\nx", True, []), ("####### a", True, []), ("a\x0bb\x0b", True, [v.VERTICAL_TABS % 2]),
    ("| a |\n|---|\n", True, [v.TABLE_NO_DATA]), ("| a | b |\n|---|:-:|\n| 1 |\n", True, [v.TABLE_MISMATCH]),
    ("| a \\| x |\n|---|\n| 1 |\n", True, []), ("| a |\n|---|\n|  |\n", True, [v.TABLE_BLANK]), ("a | b\nc | d", True, []),
    ("```\n| a |\n|---|\n```", True, []), ("## a\n\n## a\nx", True, [v.DUPLICATE_HEADING]), ("## a\nx\n## a\ny", True, []),
    ("## a\n```\ncode\n```\n## a\nx", True, [v.DUPLICATE_HEADING]), ("## a\n<!-- c -->\n## a\nx", True, []),
    ("## a\n\n---\n\n## b\nx", True, [v.EMPTY_SLIDE]), ("---\na: b\n---\n## a\nx", True, []), ("x\n\n---\n\n---\n", True, [v.EMPTY_SLIDE] * 2),
    ("---\nx", True, [v.EMPTY_SLIDE]), ("<!-- c -->\n## a\n```\ncode\n```", True, []), ("```\n---\n```\nx", True, []),
])
def test_cases(spark, md, valid, warnings):
    result = validate_markdown(md, spark=spark)
    assert (result.valid, result.warnings) == (valid, warnings)


def test_all_documents_in_one_plan(spark):
    rows = [(i, "## a\n\n## a\nx" if i % 2 else None) for i in range(50)]
    got = v.validate_documents(spark.createDataFrame([(*r, 9) for r in rows], "doc_id int, markdown string, pos int")).collect()
    assert {r["doc_id"]: r["valid"] for r in got} == {i: bool(i % 2) for i in range(50)}


PIECES = st.lists(st.sampled_from(["# a", "### b", "", "---", "```", "| a | b |", "|---|---|", "| 1 |", "|  |  |", "<!-- c -->", "text", "\x0b", " ", "## a"]), max_size=14)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES, min_size=1, max_size=20))
def test_row_order_does_not_matter(spark, documents):
    rows = [(i, "\n".join(p)) for i, p in enumerate(documents)]
    run = lambda r, n: sorted(map(str, v.validate_documents(spark.createDataFrame(r, "doc_id int, markdown string").repartition(n)).collect()))
    assert run(rows, 1) == run(rows[::-1], 3)
