"""The corpus pipeline: quality rules, language ID, near duplicates, repeated passages, packing.

Each stage takes the documents that its predecessor kept. Filters return whole rows unchanged:

* quality rules: rejected documents go;
* language ID: documents without letters (`und`), or whose best score is below MIN_SCORE, go (text of
  no language that was learned has 0.05 to 0.24 there, prose of 50 words 0.29 or more at any length);
* n-gram Jaccard join: of each class of near duplicates the row with the lowest doc_id stays (null
  sorts last); several texts under one doc_id are documents of their own;
* substring dedup: every document stays, without passages that an earlier one has (a changed text
  is its remaining words joined by spaces, n_chars follows);
* best-fit packing: returns the pieces with their sequences.

Edge cases: null, empty and blank texts fail the quality stage's base rule; a null lang is a stratum of
its own there and isn't learned from; null doc_ids have no label and are kept apart by their texts;
repeated rows are near duplicates of each other; very long texts are read whole by every stage; columns
other than those of documents are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import language, neardup, packing, quality, substrings
from folia.llm.common import cut, drop_all_but, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.25


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    policy = quality.Policy()
    # Features are written with the rows: the verdict then is a plain filter on a narrow read.
    scored = cut(quality.features(docs.select("doc_id", "text", "lang", F.struct(*COLUMNS).alias("_doc"))), "quality")
    chosen = cut(quality.cutoffs(scored, table(spark, sf_dir, "labels"), policy), "cutoffs")
    return quality.judge(scored, chosen, policy).where("kept").select("_doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    found = language.predict(docs.select(*COLUMNS, F.col("text").alias("_text")), model, "_text")
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.substring_dedup(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), original=True)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("original"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Cutoffs learned from labels, a trained classifier and a tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents").select(*COLUMNS), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
            drop_all_but(spark, before | {docs.folder})  # what the stage and its predecessor wrote
    return docs
