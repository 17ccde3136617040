"""The training-data queries and their SQL, added to the driver's contract by ``__spark_entry__``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import balltree, lines, minhash, nbest, packing, pii, quality, tokenfile, toxicity, warc
from tessella.llm.common import table
from tessella.shared import shared_dir


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def _vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(table(spark, sf_dir, "documents"), path, _vocabulary_file("word_bpe_49k.json"), 49_408, end_id=2)
    return tokenfile.read(spark, path, with_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary_file("byte_bpe_50k.json"))


def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = balltree.quantized(table(spark, sf_dir, "embeddings"))
    return balltree.top_k(vectors.where("id % 50 = 0"), vectors)


def op3_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.drill(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode_documents(table(spark, sf_dir, "documents"), _vocabulary_file("piece_bpe_32k.model"), n=2).drop("ids")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.classify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op4_token_file": op4_token_file,
        "op5_toxicity": op5_toxicity,
        "op7_packing": op7_packing,
        "op9_ball_tree": op9_ball_tree,
        "op3_warc_merkle_audit": op3_warc_merkle_audit,
        "op8_sentencepiece_nbest": op8_sentencepiece_nbest,
        "op6_quality_rules": op6_quality_rules,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality.oracle_sql(), "op9_ball_tree": balltree.ORACLE_SQL, "op3_warc_merkle_audit": warc.ORACLE_SQL}
