"""Registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netresil.llm import (
    alignment, decontaminate, jaccard, language, licenses, maxent, merge_automaton, mixing, oracle, quality, substrings, syncmers, token_counts, treap,
)
from netresil.session import cut_lineage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % n


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language.learn(docs.where(remainder(4) != 2))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    found = language.identify(docs.select("doc_id", held_out, "text"), trees)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query("op2_maxent")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trained = maxent.train(docs.where(F.coalesce(remainder(5) != 1, F.lit(True))))
    held_out = F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out")
    return maxent.score(docs.select("doc_id", held_out, "text"), trained).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op3_decontaminate", oracle.DECONTAMINATE)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_substrings", oracle.SUBSTRINGS)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.remove_repeats(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_syncmers")
def op5(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op7_licenses")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.license_scan(docs, licenses.known_licenses(spark), mark_col="mark")
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select(
        "doc_id", F.size("licenses").cast("bigint").alias("n_matches"), F.concat_ws(",", names).alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["containment"])), F.lit(0.0)).alias("best"),
    )


@query("op8_jaccard_join", oracle.JACCARD)
def op8(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_quality")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    voters = quality.learn(docs, labels.where(remainder(4) != 2))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out")
    found = quality.score(docs.select("doc_id", held_out, "text"), voters)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_mixing", oracle.MIXING)
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def decimal(column):
    return F.array_join(column.cast("array<string>"), ",")


@query("op11_merge_automaton")
def op11(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = merge_automaton.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return merge_automaton.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(decimal(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_alignment")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    # The groups are told once; only the links are needed again, after all have been counted.
    told = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    held = cut_lineage(aligned.select("doc_id", "n_a", "n_b", "n_groups", told, "links"))
    return alignment.score_links(held, alignment.link_counts(held)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_treap", oracle.RANKED)
def op13(spark, sf_dir):
    return treap.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
