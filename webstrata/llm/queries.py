"""Contract queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_mih, arc_warc, bpe_tree, flac_media, html_extract, line_crf, ngram_join, piece_rounds, poisson_mix, source_audit, suffix_dedup, token_planes, vector_codes
from .common import stored, table


def op1_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_mih.usable(table(spark, sf_dir, "embeddings"))
    return ann_mih.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_digests(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document that shares a passage of 50 or more words with another: its spans and the documents that hold them first."""
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.array_distinct(F.col("spans.first_doc")).alias("first_docs"), "spans")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of the media column as stored: written, read back and decoded block by block."""
    return flac_media.media_features(stored(flac_media.to_media(table(spark, sf_dir, "documents")), "media", compression="none"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_planes(table(spark, sf_dir, "documents"))


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix_sources(table(spark, sf_dir, "documents"))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return arc_warc.convert_pages(table(spark, sf_dir, "pages")).select(*names)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rounds.piece_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_mih": op1_ann_mih,
    "op2_bpe_tree": op2_bpe_tree,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_extract": op5_html_extract,
    "op6_flac_media": op6_flac_media,
    "op7_line_crf": op7_line_crf,
    "op8_token_planes": op8_token_planes,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_arc_to_warc": op10_arc_to_warc,
    "op11_source_audit": op11_source_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_piece_rounds": op13_piece_rounds,
}
ORACLES: dict[str, str] = {
    "op9_poisson_mix": poisson_mix.ORACLE,
    "op10_arc_to_warc": arc_warc.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
