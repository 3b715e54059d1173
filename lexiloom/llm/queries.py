"""The corpus queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filteraudit, languages, licences, media, packing, passages, pii, quality, sharding, simhash, urls, vectorcodes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), 8)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(table(spark, sf_dir, "documents")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, table(spark, sf_dir, "labels")))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents"))


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages.identify(docs.select("doc_id", "text"), languages.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_shard": op4_shard,
    "op5_pii": op5_pii,
    "op6_licences": op6_licences,
    "op7_decontaminate": op7_decontaminate,
    "op8_media": op8_media,
    "op9_urls": op9_urls,
    "op10_passages": op10_passages,
    "op11_filteraudit": op11_filteraudit,
    "op12_languages": op12_languages,
    "op13_vectorcodes": op13_vectorcodes,
}

ORACLES: dict[str, str] = {
    "op5_pii": pii.oracle(),
    "op6_licences": licences.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op9_urls": urls.oracle(),
    "op10_passages": passages.oracle(),
    "op11_filteraudit": filteraudit.oracle(),
    "op13_vectorcodes": vectorcodes.oracle(),
}
