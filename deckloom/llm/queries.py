"""The subpackage's registered queries, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import ann, chat, html_extract, hpylm, langid, media, mixing, neardup, packing, quality, store
from deckloom.llm.sql import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "named_struct('role', '{}', 'content', '</s>[INST] ok [/INST]')"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.expr(f"array({said.format('user')}, {said.format('assistant')})").alias("messages")
    )
    turns = [chat.canonical_turns(x, "conv_id") for x in (table(spark, sf_dir, "conversations"), extra)]
    return chat.digests(chat.read_back(chat.format_chat(turns[0].unionByName(turns[1]))))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with the document number that ends their address, and documents,
    each table by its own evidence."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:\.html?|/)?(?:[?#].*)?$", 1)
    pages = langid.identify_pages(table(spark, sf_dir, "pages")).withColumn("doc_id", F.nullif(number, F.lit("")).cast("long"))
    docs = langid.identify_documents(table(spark, sf_dir, "documents")).withColumnRenamed("source", "host")
    return pages.unionByName(docs, allowMissingColumns=True)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_chat, op3_lm, op4_langid, op5_packing, op6_ann, op7_mixing, op8_neardup, op9_media, op10_html)
}


def clean(spark: SparkSession) -> None:
    """Remove what the queries have materialised."""
    store.clean(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
