"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import codes, collocations, embeddings, jaccard, langid, mixing, packing, resampling, substrings, topk, toxicity, urls, warc
from spanlake.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def packing_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    return jaccard.link_components(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    rows = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in windows of 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer())


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier passages."""
    return substrings.digests(table(spark, sf_dir, "documents"))


@query
def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products for every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rows = urls.judge(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict")


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    rows = mixing.words_taken(mixing.mix(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", F.col("source_size"), "target", "taken")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = langid.identify(docs)
    return rows.select("doc_id", "held_out", "lang_pred", "score")


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    return codes.round_trip(spark, table(spark, sf_dir, "documents"), packing_tokenizer())


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the rank of those drawn."""
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
