"""The driver's tables viewed as decks.

Structure that the tables lack (vertical tabs, runs of spaces, fences, phone
numbers) is put in by plain replacements, which the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deckloom.schema import SHAPES, SLIDES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as(frame: DataFrame, ddl: str, **columns: Column) -> DataFrame:
    """The columns of a schema; those not given are null."""
    fields = StructType.fromDDL(ddl).fields
    return frame.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def as_slides(frame: DataFrame, **columns: Column) -> DataFrame:
    return _as(frame, SLIDES, **columns)


def as_shapes(frame: DataFrame, **columns: Column) -> DataFrame:
    zero = {k: F.lit(0) for k in ("left", "top", "width", "height") if k not in columns}
    return _as(frame, SHAPES, **zero, **columns)


def roughened(text: Column) -> Column:
    """Text with soft breaks and runs of spaces."""
    return F.replace(F.replace(text, F.lit(" the "), F.lit("  the\x0b")), F.lit(" de "), F.lit(" \t de "))


def paragraphs_of(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.struct(roughened(x).alias("text"), (F.length(x) % 3).cast("int").alias("level")))


def document_decks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A deck a source, a slide a document: its first line is the title, the
    others are paragraphs of levels by their length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    key = {"deck_id": F.col("source"), "slide_index": F.col("doc_id")}
    slides = as_slides(docs, **key, title=F.col("lines")[0], notes=F.lit(""))
    rest = F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))
    shapes = as_shapes(docs, **key, path=F.array(F.lit(0)), kind=F.lit("text"), shape_id=F.lit(1), paragraphs=paragraphs_of(rest))
    return slides, shapes


def conversation_decks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A deck a conversation, a slide a turn with its role as title."""
    turns = table(spark, sf_dir, "conversations")
    key = {"deck_id": F.col("conv_id").cast("string"), "slide_index": F.col("turn")}
    slides = as_slides(turns, **key, title=F.col("role"), notes=F.replace("text", F.lit(" "), F.lit("\x0b")))
    one = F.array(F.struct(F.col("text").alias("text"), F.lit(0).alias("level")))
    return slides, as_shapes(turns, **key, path=F.array(F.lit(0)), kind=F.lit("text"), paragraphs=one)


def part_shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A deck a brand, a slide a size, a shape a part: kinds, places and image
    properties by arithmetic on the key."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    key = {"deck_id": F.col("p_brand"), "slide_index": F.col("p_size")}
    slides = as_slides(parts.select("p_brand", "p_size").distinct(), **key, title=F.lit(""), notes=F.lit(""))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "image", "other", "text", "image", "table", "text", "group")]), (k % 8 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in ("LINE", "CHART", "UNKNOWN", "CONNECTOR", "LINE")]), (k % 5 + 1).cast("int"))
    name = F.element_at(F.array(F.lit(None).cast("string"), F.lit("diagram"), F.lit("photo")), (k % 3 + 1).cast("int"))
    shapes = as_shapes(
        parts, **key, path=F.array(k.cast("int")), kind=kind, shape_id=k,
        top=(k * 37 % 11 - 3) * 310_000, left=k * 53 % 17 * 61_000,
        paragraphs=F.array(F.struct(F.col("p_name").alias("text"), F.lit(0).alias("level"))), is_title=k % 21 == 0, is_footer=k % 9 == 0,
        rows=F.array(F.array(F.lit("name"), F.lit("type")), F.array("p_name", "p_type")), n_rows=F.lit(2), n_cols=F.lit(2),
        mso_shape_type=label, fallback_text=F.when(k % 7 == 2, F.lit("")).otherwise(F.col("p_type")), classification=name,
        alt_text=F.when(k % 6 == 1, F.col("p_name")).otherwise(F.lit("")), description=F.when(k % 16 == 4, F.col("p_type")),
    )
    return slides, shapes


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, rows, n_rows, n_cols): an order's lines as a table; cells
    hold pipes, line breaks and signs that markup escapes."""
    line = table(spark, sf_dir, "lineitem")
    cells = F.array(
        F.col("l_partkey").cast("string"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("\n<"), F.col("l_linenumber").cast("string"), F.lit(">")),
        F.col("l_quantity").cast("int").cast("string"),
        F.concat("l_returnflag", F.lit("|"), "l_linestatus"),
    )
    order = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag", "l_linestatus", cells.alias("cells")
    )
    head = F.array(F.array(*[F.lit(x) for x in ("part", "supplier", "quantity", "flags")]))
    rows = F.concat(head, F.transform(F.sort_array(F.collect_list(order)), lambda x: x["cells"]))
    return line.groupBy("l_orderkey").agg(rows.alias("rows")).withColumns({"n_rows": F.size("rows"), "n_cols": F.lit(4)})


def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, markdown): documents with headings, rules, fences and tables
    where frequent words stood."""
    text = F.col("text")
    for old, new in STRUCTURE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("markdown"))


#: Replacements that make structure; the SQL applies the same.
STRUCTURE = (
    (" the ", "\n\n## "), (" and ", "\n\n#### "), (" of ", "\n\n---\n\n"), (" in ", "\n| a | b |\n| --- | --- |\n| x |\n"),
    (" to ", "\n```\n"), (" is ", "\n\n## twice\n\n## twice\n\n"), (" de ", "\n| c |\n|---|\n"), (" la ", "\x0b"),
    (" und ", "\n\n<!-- note -->\n\n---\n# x\n\n---\n"),
)
