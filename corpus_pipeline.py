"""A corpus made ready for training: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. ``run`` writes each stage's result as Parquet to the shared checkpoint
folder and reads it again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netresil.llm import decontaminate, jaccard, language, mixing, substrings
from netresil.session import cut_lineage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that no learned language accounts for; the languages are learned from the labelled rows."""
    return language.accepted(docs, language.learn(docs)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8), once."""
    found = cut_lineage(jaccard.jaccard_components(docs.select("doc_id", "text"), length=5, percent=80))
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    repeated = cut_lineage(found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand earlier; documents that were nothing else go."""
    done = substrings.remove_repeats(docs)
    cut = F.col("n_removed") > 0
    out = done.where(~cut | (F.col("kept") != "")).withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items).where("n_hit = 0").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source up to its target; ``taken`` is the number of words taken, repeats counted."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage scores code lengths of learned context trees, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
