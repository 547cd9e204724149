"""The registered queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .flac import media_features
from .huffman import read_huffman, write_huffman
from .languages import identify_languages, train_languages
from .lattice import sample_pieces
from .licenses import license_digest, license_oracle, scan_licenses
from .lines import count_repeated_lines
from .packing import pack_power_of_two
from .partenum import jaccard_groups, jaccard_oracle
from .quality import score_quality, train_quality
from .ranked import search_documents, search_oracle
from .secrets import scan_secrets, secret_digest, secret_oracle
from .storage import scratch_path
from .vectors import link_vectors, vector_oracle
from .whitening import whiten_vectors


def bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_power_of_two(docs, bpe_file(), with_ids=False)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op3_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"), piece_file(), with_ids=False)


def op5_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op6_segment_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_repeated_lines(table(spark, sf_dir, "documents"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op8_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "huffman")
    write_huffman(table(spark, sf_dir, "documents"), path, bpe_file())
    return read_huffman(spark, path, with_ids=False)


def op10_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))


def op12_zstd_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, train_languages(docs))


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_partenum_join": jaccard_oracle(), "op5_secret_links": secret_oracle(), "op7_license_rules": license_oracle(), "op8_pca_tiles": vector_oracle(), "op13_block_max_search": search_oracle()}
