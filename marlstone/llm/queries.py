"""One registered query for each operator, with production parameters over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import materialised

    return materialised(spark, f"{sf_dir}/documents.parquet")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_sadedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sadedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digests

    return line_digests(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import document_variants

    return document_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_simhash": op2_simhash,
        "op3_ann": op3_ann,
        "op4_bpe": op4_bpe,
        "op5_secrets": op5_secrets,
        "op6_decontam": op6_decontam,
        "op7_shards": op7_shards,
        "op8_html": op8_html,
        "op9_langid": op9_langid,
        "op10_sadedup": op10_sadedup,
        "op11_line_dedup": op11_line_dedup,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_variants": op13_variants,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from . import decontam, line_dedup, prefix_trie, variants

    return {"op6_decontam": decontam.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_variants": variants.ORACLE}
