"""The stages of the pipeline on tables with clashing columns, nulls and repeats."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

WORDS = [f"word{k}" for k in range(400)]


def text(k: int, n: int = 80) -> str:
    """Lines of different words; every text of one k is the same."""
    own = random.Random(k).choices(WORDS, k=n)
    return "\n".join(" ".join(own[i : i + 16]) for i in range(0, n, 16)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text(k), "en", "s1" if k % 3 else "s2") for k in range(40)]
    rows += [(100, text(5), "en", "s1"), (101, None, None, None), (102, "", "en", "s1"), (7, text(7), "en", "s1"), (None, text(9), "en", "s2")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    clash = ["n", "s", "host_n", "host_s", "_host", "_path", "_lines", "_frequent", "_key", "node", "component_id", "_row", "_p", "_text"]
    return base.selectExpr("*", *[f"cast(doc_id as string) as {c}" for c in clash], "map('a', doc_id) as m")


def test_rules_and_copies_leave_other_columns_alone(spark, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == {*range(40), 100, None}
    assert all(r[c] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in ("n", "_lines", "_frequent", "_row"))
    one = corpus_pipeline.near_copies(spark, kept, "")
    assert one.columns == docs.columns
    ids = [r["doc_id"] for r in one.collect()]
    assert sorted(x for x in ids if x is not None) == list(range(40)) and None in ids
    assert corpus_pipeline.near_copies(spark, docs.select("doc_id", "text"), "").columns == ["doc_id", "text"]
    none = docs.limit(0)
    assert corpus_pipeline.quality_rules(spark, none, "").count() == 0 and corpus_pipeline.near_copies(spark, none, "").count() == 0


def test_the_classifier_meets_any_column(spark, docs, tmp_path):
    labels = [(k, int(k % 2 == 0), 0) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.quality_classifier(spark, docs.drop("m"), str(tmp_path))
    assert kept.columns == docs.drop("m").columns
    rows = kept.collect()
    assert rows and all(r["host_n"] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in rows)


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_copies", "best_fit_packing"]
