"""A training corpus from raw documents: classify, apply rules, drop near copies, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; between stages the documents are
written as Parquet and read again.  ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import classifier, jaccard, packing, rules
from clickloom.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Models, tokens and similarity sets are out of SQL's reach.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, holds for good."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.classified(docs, model).where("_kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the boilerplate lines of their source."""
    return rules.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; texts without words stay.

    Rows without an id stay.  Rows that share one are a group too: the last in the order of their JSON stays.  Other
    columns may have any names and types; an empty table gives an empty result.
    """
    groups = stored(jaccard.similar_groups(docs), "groups")
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    docs = docs.join(stored(gone, "gone"), "doc_id", "left_anti")
    # Rows that share an id are one group too; usually there are none, and then nothing is shuffled.
    again = groups.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = stored(again.where("n > 1").select("doc_id"), "again")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(row, F.to_json(row)).alias("_row"))
    one = one.select("_row.*")
    return docs.join(again, "doc_id", "left_anti").unionByName(one).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents, cut and packed into sequences of 2048 tokens."""
    # Executors hold the memory of the steps before, so fewer units are kept than by default.
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0, units=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents at ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
