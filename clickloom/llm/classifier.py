"""Operator 4: document quality by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import stored

#: Rows of the labelled sample that the document model is fitted on, at most; taken in the order of a hash.
SAMPLE = 20_000
_EDGE = 1e-6


def features(text: Column) -> list[Column]:
    """What the document model sees: rates of marks, capitals and repeats, and the mean length of words."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.size(F.split(t, r"[\x20\x09-\x0D]+")), F.lit(1)).cast("double")
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    repeats = r"(?<!\S)(\S+)\s(?=\1(?!\S))"
    return [
        count(r"[#*$%&|<>]+") / words,
        count("!+") / words,
        count(r"\p{Lu}+") / chars,
        count(repeats) / chars,
        count("[.,;:]+") / words,
        chars / words,
    ]


@dataclass(frozen=True)
class Model:
    """A logistic model; ``weights`` belong to the features as they are."""

    bias: float
    weights: tuple[float, ...]

    def logit(self, text: Column) -> Column:
        out = F.lit(self.bias)
        for w, x in zip(self.weights, features(text), strict=True):
            out = out + F.lit(w) * x
        return out


def fit(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Fit the document model on at most ``sample`` labelled rows.

    Rows without a label or a document do not count.  Without any, or with one class only, the model gives every
    document the log-odds of that class (smoothed), so that documents are kept unless all labels say otherwise.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    chosen = chosen.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)  # bounded, so it may be broadcast
    named = df.select(F.col(key).alias("_of"), F.col(text).alias("_text"))
    rows = named.join(F.broadcast(chosen), F.col("_of") == F.col("_key"))
    got = rows.select("_label", *(x.alias(f"x{i}") for i, x in enumerate(features(F.col("_text"))))).toPandas()
    got = got.sort_values(list(got), ignore_index=True).to_numpy(float)  # the order of tasks does not count
    y, x = got[:, 0], got[:, 1:]
    if len(y) == 0 or y.min() == y.max():
        good = float(y.sum())
        return Model(float(np.log((good + 1) / (len(y) - good + 0.5))), (0.0,) * len(features(F.lit(""))))
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    ridge = np.r_[1e-6, np.full(x.shape[1], 0.1)]
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return Model(float(w[0] - weights @ mean), tuple(map(float, weights)))


def _strength(groups: DataFrame, mean: Column, n: Column, expected: Column) -> Column:
    """Prior rows that a group's expected rate is worth, by moments: few where groups differ more than chance would."""
    total, spread = F.sum(n), F.sum(n * (mean - expected) * (mean - expected))
    noise = F.sum(expected * (1 - expected))
    rho = (spread - noise) / F.nullif(F.sum(n * expected * (1 - expected)), F.lit(0.0))
    return F.when(total > 0, 1 / F.least(F.greatest(rho, F.lit(1e-4)), F.lit(0.5)) - 1)


def sites(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float, float]:
    """Soft counts by (host, path), with those of the host; the global rate, and the strengths of both priors."""
    by_path = scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path"))
    by_path = stored(by_path.agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s")), "paths")
    by_host = stored(by_path.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    whole = by_host.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    rate = min(max((whole["s"] + 1.0) / (whole["n"] + 2.0), _EDGE), 1 - _EDGE) if whole["n"] else 0.5
    upper = by_host.agg(
        _strength(by_host, F.col("host_s") / F.col("host_n"), F.col("host_n"), F.lit(rate)).alias("m")
    ).first()["m"]
    joined = by_path.join(
        by_host.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of"))
    ).drop("_of")
    expected = (F.col("host_s") + (upper or 1.0) * rate) / (F.col("host_n") + (upper or 1.0))
    lower = joined.agg(_strength(joined, F.col("s") / F.col("n"), F.col("n"), expected).alias("m")).first()["m"]
    return stored(joined, "sites"), rate, upper or 1.0, lower or 1.0


def classified(
    df: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang", least: float = 0.5
) -> DataFrame:
    """Add _doc_logit, _site_rate, _probability and _kept to every row.

    The document model gives each row its own evidence.  Summed over host, and over host and path, it gives every
    site a rate that is shrunk to the level above it (path to host, host to the whole corpus), the more the fewer
    rows a site has; how much is estimated from how far sites differ beyond chance.  A row's own evidence is taken
    out of its site before its site speaks for it.  The log-odds of row and site are added, and rows with a
    probability of at least ``least`` are kept.

    Null and empty texts have the features of an empty text, null hosts and paths are sites like others, repeated
    rows count each, an empty table gives an empty result.  Columns of df stay, whatever their names; one that is
    named like an added column is replaced by it.
    """
    logit = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), model.logit(F.col(text))))
    # The row travels as one column, so that its names meet no others.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    scored = df.select(whole, F.col(host).alias("_of_host"), F.col(path).alias("_of_path"), logit.alias("_doc_logit"))
    chance = 1 / (1 + F.exp(-F.col("_doc_logit")))
    found, rate, upper, lower = sites(scored.select("_of_host", "_of_path", chance.alias("_p")), "_of_host", "_of_path")
    # Sites are joined without a hint: they are broadcast where their stored size is under the session's limit.
    joined = scored.withColumn("_p", chance).join(
        found, F.col("_of_host").eqNullSafe(F.col("_host")) & F.col("_of_path").eqNullSafe(F.col("_path"))
    )
    of_host = (F.col("host_s") - F.col("_p") + upper * rate) / (F.col("host_n") - 1 + upper)
    of_site = (F.col("s") - F.col("_p") + lower * of_host) / (F.col("n") - 1 + lower)
    joined = joined.withColumn("_site_rate", F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), of_site)))
    shift = F.log(F.col("_site_rate") / (1 - F.col("_site_rate"))) - F.lit(float(np.log(rate / (1 - rate))))
    joined = joined.withColumn("_probability", 1 / (1 + F.exp(-(F.col("_doc_logit") + shift))))
    kept = F.col("_probability") >= least
    added = ["_doc_logit", "_site_rate", "_probability", "_kept"]
    own = [F.col("_row")[c].alias(c) for c in df.columns if c not in added]
    return joined.withColumn("_kept", kept).select(*own, *added)
