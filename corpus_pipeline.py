"""The corpus pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run`
writes every stage's result as Parquet to shared storage and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, packing, toxicity
from tessera.llm.common import bit_table, by_bits, materialise, shared_dir, table

#: SQL expresses neither classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """docs with columns of these names renamed, and the columns that restore docs."""
    back = {c: f"__own_{c}" if c in names else c for c in docs.columns}
    return docs.select([F.col(c).alias(n) for c, n in back.items()]), [F.col(n).alias(c) for c, n in back.items()]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    own, back = _aside(docs, ("toxic_score", "toxic_predicted"))
    model = toxicity.fit(own, table(spark, sf_dir, "labels"), shared_dir(spark))
    return toxicity.score(own, model).where("toxic_predicted = 0").select(back)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike any language of the training rows, go."""
    own, back = _aside(docs, ("lang_pred", "lang_score", "lang_rejected"))
    model = langid.fit(own, shared_dir(spark))
    return langid.predict(own, model).where("not lang_rejected").select(back)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; of rows that repeat a doc_id, one. Links: 5-word shingles, Jaccard 0.8 or more."""
    folder = shared_dir(spark)
    groups = materialise(jaccard.join(docs, folder, percent=80, k=5), f"{folder}/groups")
    gone = materialise(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), f"{folder}/gone")
    # most documents are known to stay by a bitmap of fixed size and need no shuffle
    bits = bit_table(gone, "__gone", f"{folder}/gone-bits")
    kept = by_bits(docs, "doc_id", bits, True).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").unionByName(by_bits(docs, "doc_id", bits, False))
    twice = materialise(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")), f"{folder}/twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti")
    return once.unionByName(kept.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in sequences of at most 1024 tokens, one row per piece; null text is the end id alone, an empty table gives no rows."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("ngram_jaccard", jaccard_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
