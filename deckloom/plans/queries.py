"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.api import ConvertOptions, convert_contents, to_markdown
from deckloom.functions import headings, images, tables, text
from deckloom.operators.assemble import assemble_documents, suppress_repeated_labels
from deckloom.operators.complexity import complexity_scores, has_columns, route_slides
from deckloom.operators.enrich import enrich_descriptions, image_groups, masking_metrics, reconstruct_slides
from deckloom.operators.render import assemble_slides, reading_order
from deckloom.operators.validate import heading_level, is_separator_row, row_cells, validate_documents
from deckloom.plans import views
from deckloom.sources.decks import parse_files, split_records
from deckloom.sources.pixels import image_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def assemble_document_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_documents(*views.document_decks(spark, sf_dir))


@query
def assemble_conversation_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_documents(*views.conversation_decks(spark, sf_dir))


@query
def assemble_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_documents(*views.conversation_decks(spark, sf_dir), include_notes=True)


@query
def frontmatter_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_documents(*views.conversation_decks(spark, sf_dir), emit_frontmatter=True)


@query
def single_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_slides(*views.document_decks(spark, sf_dir))


@query
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside every document's slide one without shapes, half of them without
    a title."""
    slides, shapes = views.document_decks(spark, sf_dir)
    title = F.when(F.col("slide_index") % 2 == 0, F.lit("")).otherwise(F.col("title"))
    bare = slides.withColumns({"slide_index": F.col("slide_index") + 10_000_000, "title": title})
    return assemble_documents(slides.unionByName(bare), shapes, emit_toc=True)


@query
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides, shapes = views.document_decks(spark, sf_dir)
    return assemble_documents(slides, shapes, masking=text.MaskingOptions(enabled=True))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = F.replace(views.roughened(F.col("text")), F.lit("\n"), F.lit("\n\n\n"))
    clean = text.collapse_blank_lines(text.normalize_text(rough))
    return views.table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))


@query
def mask_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.replace("text", F.lit(" the "), F.lit(" 010-1234-5678 "))
    masked = text.mask_text(said, text.MaskingOptions(enabled=True))
    return views.table(spark, sf_dir, "documents").select("doc_id", masked.alias("masked"))


@query
def mask_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    masking = text.MaskingOptions(enabled=True, patterns=(r"[A-Z][a-z]+", r"\d+"))
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.mask_text(F.col("text"), masking).alias("masked"))


@query
def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = views.table(spark, sf_dir, "customer").join(
        F.broadcast(views.table(spark, sf_dir, "nation").join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))),
        F.col("c_nationkey") == F.col("n_nationkey"),
    )  # 25 rows
    title = F.concat("r_name", F.lit(" > > "), "n_name", F.lit(">"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")))
    lines = headings.heading_lines(title, hierarchy=True)
    return nations.select("c_custkey", F.array_join(lines, "\n").alias("headings"), headings.section_of(lines).alias("section"))


@query
def notes_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of every turn, and as many blank ones."""
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.replace("text", F.lit(" "), F.lit("\x0b")).alias("notes"))
    blank = turns.select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.lit(" \x0b ").alias("notes"))
    return turns.unionByName(blank).withColumn("notes", headings.notes_block(F.col("notes")))


def _tables(render: Callable[..., object]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views.order_tables(spark, sf_dir).select("l_orderkey", render(F.col("rows"), F.col("n_rows"), F.col("n_cols")).alias("markdown"))

    return run


QUERIES["gfm_table"] = _tables(lambda rows, _n, _m: tables.gfm_table(rows))
QUERIES["mermaid_table"] = _tables(tables.mermaid_table)
QUERIES["table_data"] = _tables(tables.table_data)
QUERIES["html_table"] = _tables(lambda rows, _n, _m: tables.html_table(rows))
QUERIES["table_markdown"] = _tables(lambda rows, n, m: tables.table_markdown(rows, n * 3, m, "html"))


@query
def ragged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of more and fewer cells than the header."""
    cells = F.slice(F.split("p_name", " "), 1, (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = F.array(F.array(F.lit("a"), F.lit("b")), cells, F.array("p_brand"))
    return views.table(spark, sf_dir, "part").select("p_partkey", tables.gfm_table(rows).alias("markdown"))


@query
def complex_table_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(F.lit(" x "), F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.lit("y")), F.lit(""), F.lit(" "))
    rows = F.array(cells, F.array("p_name"))
    size, width = (F.col("p_size") + 1).cast("int"), (F.col("p_partkey") % 11).cast("int")
    blank = F.when(F.col("p_partkey") % 5 == 0, F.array(F.array(F.lit(" "), F.lit("\t")))).otherwise(rows)
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", tables.is_complex_table(rows, size, width).alias("is_complex"), tables.is_blank_table(blank).alias("is_blank")
    )


@query
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pipe rows read back, and separator rows told apart."""
    row = F.concat(F.lit("| "), "p_name", F.lit(r" \| "), "p_type", F.lit(" |"), "p_brand", F.when(F.col("p_partkey") % 2 == 0, F.lit(" |")).otherwise(F.lit("")))
    rule = F.when(F.col("p_partkey") % 3 == 0, F.lit("| --- | :-: |")).when(F.col("p_partkey") % 3 == 1, F.lit("--- | x")).otherwise(F.lit("||"))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(row_cells(row), "\n").alias("cells"), is_separator_row(rule).alias("is_separator")
    )


@query
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.repeat(F.lit("#"), (F.col("p_partkey") % 9).cast("int")), F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "p_name")))
    return views.table(spark, sf_dir, "part").select("p_partkey", heading_level(line).alias("level"))


@query
def reading_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shapes = views.part_shapes(spark, sf_dir)
    return reading_order(shapes).select("deck_id", "slide_index", "shape_id", "rank")


@query
def image_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of all kinds of shapes, images numbered in reading order."""
    return assemble_slides(*views.part_shapes(spark, sf_dir))


@query
def image_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shapes = views.part_shapes(spark, sf_dir)
    marker = images.image_markdown(F.col("description"), F.col("alt_text"), F.col("classification"), F.col("slide_index"), F.col("shape_id"))
    return shapes.select("shape_id", marker.alias("marker"))


@query
def image_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    width, height = k * 7 % 256 + 1, k * 13 % 256 + 1
    features = F.struct(
        width.alias("width"), height.alias("height"), (width / height).alias("aspect_ratio"), (k * 31 % 300).alias("n_unique_colors"),
        (k * 17 % 100 / 100).alias("color_fraction"), (k * 11 % 40 / 100).alias("edge_density"), (k * 19 % 100 / 100).alias("bg_fraction"),
        (k % 5 == 0).alias("has_alpha"),
    )
    return views.table(spark, sf_dir, "part").select("p_partkey", images.image_class(features).alias("class"))


@query
def hints_and_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("text", "diagram", "photo", "logo")], F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    extension = F.element_at(F.array(*[F.lit(x) for x in ("PNG", "jpg", "jpeg", "gif", "webp", "bmp")]), (k % 6 + 1).cast("int"))
    hint = images.shape_hint(name, diagram_mermaid=True)
    alt = F.when(k % 2 == 0, F.col("p_name")).otherwise(F.lit(""))
    return views.table(spark, sf_dir, "part").select(
        "p_partkey", images.prompt(hint, alt).alias("prompt"), images.media_type(extension).alias("media_type"), images.is_vector(extension).alias("is_vector")
    )


@query
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.repeat("p_name", 5).cast("binary")
    return views.table(spark, sf_dir, "part").select("p_partkey", text.data_url(body).alias("line"))


@query
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexity_scores(*views.part_shapes(spark, sf_dir))


@query
def multi_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shapes = views.part_shapes(spark, sf_dir)
    texts = F.collect_list(F.struct("top", "left"))
    return shapes.groupBy("deck_id", "slide_index").agg(texts.alias("texts")).select("deck_id", "slide_index", has_columns(F.col("texts")).alias("columns"))


@query
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = complexity_scores(*views.part_shapes(spark, sf_dir))
    routed = route_slides(scored, max_slides=5, force_render=(1, 2, 3), force_text=(3, 4))
    return routed.select("deck_id", "slide_index", "score")


class _Echo:
    """A describer and reconstructor that says what it was given."""

    def describe(self, image_bytes, image_ext, shape_hint):
        return f"{image_ext} of {len(image_bytes)} bytes: {shape_hint or 'no hint'}"

    def reconstruct(self, image_bytes, image_ext, context):
        return f"### rebuilt {context.slide_index}\n\n{len(context.text_outline)} characters, {len(image_bytes)} bytes"


def _image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, so that equal texts are equal images."""
    docs = views.table(spark, sf_dir, "documents")
    extension = F.when(F.col("doc_id") % 2 == 0, F.lit("PNG")).otherwise(F.lit("jpg"))
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("photo")).when(F.col("doc_id") % 3 == 1, F.lit("logo"))
    return views.as_shapes(
        docs, deck_id=F.lit("all"), slide_index=F.col("doc_id"), path=F.array(F.lit(0)), kind=F.lit("image"), image_bytes=F.col("text").cast("binary"),
        image_ext=extension, classification=name,
    )


@query
def describe_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = enrich_descriptions(_image_shapes(spark, sf_dir), _Echo())
    return shapes.select(F.col("slide_index").alias("doc_id"), "description")


@query
def image_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_groups(_image_shapes(spark, sf_dir)).select("hash", "n_shapes", "extension", "classification")


@query
def reconstruct_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides, shapes = views.part_shapes(spark, sf_dir)
    decks = slides.select("deck_id").distinct().withColumn("source_path", F.col("deck_id"))

    def renderer(deck, indices, *, dpi=150):
        return {i: None if i % 10 == 9 else f"{deck} {i % 7}".encode() for i in indices}

    done = reconstruct_slides(decks, slides, shapes, _Echo(), renderer=renderer, max_slides=9, force_text=(5,), embed=True)
    return done.where("reconstructed_md IS NOT NULL").select("deck_id", "slide_index", "reconstructed_md")


@query
def suppress_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks that repeat labels of the turn before."""
    turns = views.table(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 3 == 2, F.lit("other")).otherwise(F.lit(" same label "))
    block = F.concat(F.lit("## "), "role", F.lit("\n\n"), label, F.lit("\n\n"), F.lit("kept "), F.col("turn").cast("string"), F.lit("\n"), label)
    blocks = turns.select(F.col("conv_id").cast("string").alias("deck_id"), F.col("turn").alias("slide_index"), F.lit("").alias("title"), block.alias("block"))
    return suppress_repeated_labels(blocks).select("deck_id", "slide_index", "block")


@query
def flowcharts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("flowchart TD")).when(F.col("doc_id") % 3 == 1, F.lit("Graph LR;")).otherwise(F.lit("graphic"))
    lines = F.replace(F.replace("text", F.lit("```"), F.lit("''\'")), F.lit(" "), F.lit(" \n"))
    body = F.concat(F.lit("before\n```Mermaid \n\n"), first, F.lit("  \n"), lines, F.lit("\n\n```\n```mermaid\nx\n```"))
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("no fence "), lines)).otherwise(body)
    return views.table(spark, sf_dir, "documents").select("doc_id", text.flowchart_fence(said).alias("fence"))


@query
def validate_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = validate_documents(views.structured_documents(spark, sf_dir))
    return done.select("doc_id", "valid", F.array_join("warnings", "\n").alias("warnings"))


@query
def validate_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, and as many null ones."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"))
    null = docs.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(None).cast("string").alias("markdown"))
    done = validate_documents(docs.unionByName(null))
    return done.select("doc_id", "valid", F.array_join("warnings", "\n").alias("warnings"))


def _deck_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck file of two slides for each document."""
    docs = views.table(spark, sf_dir, "documents")
    spec = docs.select(F.col("doc_id").cast("string").alias("path"), F.split("text", "\n").alias("lines"))

    def run(batches):
        from deckloom.sources.writer import SlideXml, write_deck

        for batch in batches:
            contents = []
            for lines in batch["lines"]:
                clean = ["".join(c for c in x if c >= " ") for x in lines]
                first = SlideXml(notes="note").text([(clean[0], 0)], placeholder="title").text([(x, n % 2) for n, x in enumerate(clean[1:])])
                second = SlideXml().table([["h", "v"], [clean[0], str(len(clean))]]).connector()
                contents.append(write_deck([first, second]))
            yield batch[["path"]].assign(content=contents)

    # small rows that are costly to write and to parse: spread them first
    return spec.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path STRING, content BINARY")


@query
def deck_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_files(_deck_files(spark, sf_dir)).where("record = 'shape' AND kind = 'text'")
    return rows.select(
        "deck_id", "slide_index", F.col("path")[0].alias("place"), "is_title",
        F.array_join(F.transform("paragraphs", lambda p: F.concat(p["level"].cast("string"), F.lit(" "), p["text"])), "\n").alias("paragraphs"),
    )


@query
def convert_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packages to Markdown in one pass."""
    return convert_contents(_deck_files(spark, sf_dir))


@query
def convert_deck_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of the deck, slide and shape tables."""
    return to_markdown(split_records(parse_files(_deck_files(spark, sf_dir))))


def _rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck file for each part: a picture, a chart, a diagram, a connector
    and notes on the first slide, and a group of a text, a table and a group
    on the second."""
    spec = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_name", "p_type", "p_brand")

    def run(batches):
        from deckloom.sources.writer import SlideXml, write_deck

        for batch in batches:
            contents = []
            for name, kind, brand in zip(batch["p_name"], batch["p_type"], batch["p_brand"], strict=True):
                first = SlideXml(notes=f"{name}\x0b{brand}").text([(name, 0)], placeholder="title", at=(0, 0, 9, 9))
                first.image(b"no image", at=(0, 1_000_000, 9, 9)).chart(kind, [name, brand], "series", at=(0, 2_000_000, 9, 9))
                first.diagram([brand, kind], at=(0, 3_000_000, 9, 9)).connector(at=(0, 4_000_000, 9, 9))
                inner = SlideXml().text([(kind, 0), (brand, 1)])
                group = SlideXml().text([(name, 0)]).table([["a", "b"], [brand, name]]).group(inner)
                contents.append(write_deck([first, SlideXml().group(group)]))
            yield batch[["path"]].assign(content=contents)

    return spec.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path STRING, content BINARY")


@query
def convert_rich_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures, frames, nested groups and notes, from packages to Markdown,
    validated on the way."""
    done = convert_contents(_rich_files(spark, sf_dir), ConvertOptions(include_notes=True, validate=True))
    return done.select("deck_id", "markdown", "valid", F.array_join("warnings", "\n").alias("warnings"))


@query
def rich_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and places of the shapes of those decks, groups' children below
    their group."""
    rows = parse_files(_rich_files(spark, sf_dir)).where("record = 'shape'")
    place = F.array_join(F.transform("path", lambda x: x.cast("string")), ".")
    return rows.select("deck_id", "slide_index", place.alias("place"), "kind", F.coalesce("fallback_text", F.lit("")).alias("fallback_text"))


@query
def masking_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that masking finds in each source's documents."""
    _, shapes = views.document_decks(spark, sf_dir)
    return masking_metrics(shapes, text.MaskingOptions(enabled=True, patterns=(r"[A-Z][a-z]+", r"\d+")))


@query
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images drawn from part keys, decoded and measured; plain colours have
    features that SQL can tell."""

    def run(batches):
        import struct
        import zlib

        def chunk(kind, body):
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        for batch in batches:
            contents = []
            for k in batch["shape_id"]:
                width, height = int(k) % 30 + 1, int(k) % 20 + 1
                row = b"\0" + bytes([int(k) % 256, 0, 0]) * width
                head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
                contents.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(row * height)) + chunk(b"IEND", b""))
            yield batch.assign(image_bytes=contents)

    keys = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("shape_id"))
    drawn = keys.mapInPandas(run, "shape_id LONG, image_bytes BINARY").withColumn("image_ext", F.lit("png"))
    found = image_features(drawn)
    keyed = drawn.select("shape_id", F.sha2("image_bytes", 256).alias("hash"))
    return keyed.join(found, "hash").select(
        "shape_id", "features.width", "features.height", "features.n_unique_colors", "features.color_fraction", "features.edge_density",
        "features.bg_fraction", "features.has_alpha", images.image_class(F.col("features")).alias("class"),
    )


def queries() -> dict[str, Query]:
    return dict(QUERIES)


__all__ = ["QUERIES", "queries"]
