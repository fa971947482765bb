"""Operator 1: quality rules, with the frequency of lines across documents.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import stored

_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"

#: A line is boilerplate of its host in more than this many of its distinct documents, and this share of them.
MOST_DOCUMENTS = 50
MOST_PERCENT = 10
#: A document is depleted when less than this share of its lines' characters is left.
LEAST_PERCENT_LEFT = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, pattern: str) -> Column:
    """Characters of a class; nothing is allocated for texts that have none."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def words_of(text: Column) -> Column:
    """The words; splitting at one character needs no regular expression."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def _windows(words: Column) -> Column:
    """A hash of every three neighbouring words."""
    some = lambda w: F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return _let(words, lambda w: F.transform(some(w), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))


def _repeated_words(windows: Column) -> Column:
    """Words that lie in a window which occurs twice or more; sorting finds the windows, so it takes n log n steps."""

    def covered(z: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(z, i)["g"] == x["g"], F.lit(False))
        twice = F.filter(z, lambda x, i: same(i - 1, x) | same(i + 1, x))
        return _let(
            F.array_sort(F.transform(twice, lambda x: x["p"])),
            lambda p: F.aggregate(
                F.zip_with(
                    F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(F.lit(3), b - a)
                ),
                F.lit(3),
                lambda s, x: s + x,
            ),
        )

    places = F.sequence(F.lit(0), F.size(windows) - 1)
    zipped = F.arrays_zip(windows.alias("g"), places.alias("p"))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, _let(F.sort_array(zipped), covered)).otherwise(0)


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def line_hash(line: Column) -> Column:
    """A line in lower case, its white space made single spaces, as a hash."""
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(_BLANKS)), f"{_SPACE}+", " ")))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _lines (hash, length) and _sign.

    _sign is the document's identity when documents are counted: a hash of the whole text in lower case, its white
    space made single spaces, so that copies of a document count as one and do not make its lines boilerplate.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words_of(whole)).withColumn("_full", F.filter(F.split(whole, "\n"), has_word))
    df = df.withColumn("_windows", _windows(F.col("_words")))
    line = lambda x: F.struct(line_hash(x).alias("h"), F.length(x).alias("w"))
    df = df.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_n_symbols": _count(whole, r"[#*$%&|<>]").cast("long"),
            "_n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "_n_repeat_words": _repeated_words(F.col("_windows")).cast("long"),
            "_lines": F.transform("_full", line),
            "_sign": F.xxhash64(F.lower(F.array_join("_words", " "))),
        }
    )
    return df.drop("_words", "_full", "_windows")


def _sum(lines: str) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + x["w"])


def base_failed() -> Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def boilerplate(
    rows: DataFrame, host: str = "source", documents: int = MOST_DOCUMENTS, percent: int = MOST_PERCENT
) -> DataFrame:
    """(_host, _frequent): the hashes of each host's lines that are in more than ``documents`` of its documents and in
    more than ``percent`` % of them.

    A host has at most 100 / percent times as many of them as its documents have lines on average, so a list of them
    is small.  Counts are combined before every shuffle, by line and then by document sign, so that neither a
    hot host nor a hot line meets in one task.
    """
    named = rows.select(F.col(host).alias("_host"), "_sign", "_lines")
    lines = named.select("_host", "_sign", F.explode(F.array_distinct(F.col("_lines.h"))).alias("h")).distinct()
    counts = lines.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > documents)
    hosts = named.select("_host", "_sign").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("all"))
    hosts = hosts.withColumnRenamed("_host", "_of")
    found = counts.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).where(
        100 * F.col("n") > percent * F.col("all")
    )
    return stored(found.groupBy("_host").agg(F.collect_list("h").alias("_frequent")), "boilerplate")


def judged(rows: DataFrame, frequent: DataFrame, host: str = "source", left: int = LEAST_PERCENT_LEFT) -> DataFrame:
    """Add _removed_lines, _removed_chars, _base_failed and _kept to measured rows, and _frequent of their host."""
    named = frequent.withColumnRenamed("_host", "_of")
    joined = rows.join(named, F.col(host).eqNullSafe(F.col("_of")), "left").drop("_of")
    gone = F.filter("_lines", lambda x: F.array_contains(F.col("_frequent"), x["h"]))
    gone = F.when(F.col("_frequent").isNotNull(), gone).otherwise(F.slice("_lines", 1, 0))
    joined = joined.withColumn("_gone", gone).withColumns(
        {
            "_removed_lines": F.size("_gone").cast("long"),
            "_removed_chars": _sum("_gone"),
            "_base_failed": base_failed(),
        }
    )
    enough = 100 * (_sum("_lines") - F.col("_removed_chars")) >= left * _sum("_lines")
    return joined.withColumn("_kept", ~F.col("_base_failed") & enough).drop("_gone")


def rules(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The measures and the verdict for every row.

    Lines are normalised and hashed, their distinct documents counted by host, boilerplate lines taken off, and
    documents that fail a base rule or are depleted by it rejected.  Returns (key, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, removed_lines, removed_chars, base_failed, kept), a row for each row.  A null text
    has no words and fails; a null host is a host; repeated rows stay; an empty table gives an empty result.  The
    texts are read once: what is stored of them are measures and line hashes.
    """
    narrow = df.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    rows = stored(measured(narrow, "_text").drop("_text"), "measures")
    out = judged(rows, boilerplate(rows, "_host"), "_host")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "removed_chars"]
    return out.select(F.col("_key").alias(key), *(F.col(f"_{n}").alias(n) for n in [*names, "base_failed", "kept"]))


def cleaned(df: DataFrame, text: str = "text", host: str = "source", chars: str | None = "n_chars") -> DataFrame:
    """The documents that the rules keep, without boilerplate lines; columns as before, whatever their names.

    Texts without such a line stay as they are; where one goes, ``chars`` (if the table has it) is counted anew.  A null
    or empty text fails the base rules, so its row goes; a null host is a host; repeated rows are judged each; an empty
    table gives an empty result.
    """
    # The row travels as one column, so that its names meet no others.  Stored, so that the measures are taken once, and
    # not again inside the filter that Spark would push below them.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    named = df.select(whole, F.col(text).alias("_text"), F.col(host).alias("_host"))
    rows = stored(measured(named, "_text").drop("_text"), "measures")
    kept = judged(rows, boilerplate(rows, "_host"), "_host").where("_kept")
    stays = lambda x: ~(has_word(x) & F.array_contains(F.col("_frequent"), line_hash(x)))
    old = F.col("_row")[text]
    rest = F.array_join(F.filter(F.split(old, "\n"), stays), "\n")
    changed = F.col("_removed_lines") > 0
    new = {text: F.when(changed, rest).otherwise(old)}
    if chars in df.columns:
        new[chars] = F.when(changed, F.length(rest).cast(df.schema[chars].dataType)).otherwise(F.col("_row")[chars])
    return kept.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in df.columns])
