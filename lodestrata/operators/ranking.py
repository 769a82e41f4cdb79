"""Scores of options by record: softmax over chunks, shortlists, wide score tables, applied classifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.rollup import softmax, top_n


def chunk_softmax(scores: DataFrame, record: str, chunk: str, option: str, logp: str, temperature: float = 1.0) -> DataFrame:
    """``(record, option, logp)``: softmax over the options within each chunk, mean over the record's chunks, logarithm.

    A chunk without an option counts zero for it; an option in no chunk gives no row. Null scores are left out.
    """
    p = softmax(scores.select(record, chunk, option, logp), [record, chunk], logp, "_p", temperature)
    chunks = scores.groupBy(record).agg(F.count_distinct(chunk).alias("_k"))
    mean = p.groupBy(record, option).agg(F.sum("_p").alias("_s")).join(chunks, record)
    return mean.select(record, option, F.log(F.col("_s") / F.col("_k")).alias(logp))


def metric_means(log: DataFrame, name: str, value: str) -> DataFrame:
    """``(name, mean, n)`` of a log of metrics; null values are left out."""
    return log.groupBy(name).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def shortlist(scores: DataFrame, record: str, option: str, score: str, n: int, above: float | None = None, at_least: float | None = None) -> DataFrame:
    """The best ``n`` options of each record (ties by option) whose score is above, or at least, a bound: the two differ on the bound itself."""
    best = top_n(scores.where(F.col(score).isNotNull()), record, score, option, n)
    if above is not None:
        best = best.where(F.col(score) > above)
    return best.where(F.col(score) >= at_least) if at_least is not None else best


def wide_scores(scores: DataFrame, record: str, option: str, score: str, top: int = 5) -> DataFrame:
    """One row a record: its best options with their probability in columns top_1, top_1_p, …, and all of them as a map ``scores``.

    The map carries what a table with a column an option would, without a plan that grows with the options; ``score_columns`` makes
    columns of it for a given list.
    """
    p = softmax(scores.select(record, option, score).where(F.col(option).isNotNull()), [record], score, "_p")
    best = top_n(p, record, "_p", option, top).groupBy(record).agg(*[x for i in range(1, top + 1) for x in (F.max(F.when(F.col("rank") == i, F.col(option))).alias(f"top_{i}"), F.round(F.max(F.when(F.col("rank") == i, F.col("_p"))), 6).alias(f"top_{i}_p"))])
    maps = p.groupBy(record).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(option).alias("k"), F.round("_p", 6).alias("v"))))).alias("scores"))
    return best.join(maps, record)


def score_columns(wide: DataFrame, options: list[str], prefix: str = "score_") -> DataFrame:
    """``wide`` with a column for each listed option, 0 where the record has none."""
    return wide.select("*", *[F.coalesce(F.try_element_at("scores", F.lit(o)), F.lit(0.0)).alias(f"{prefix}{o}") for o in options]).drop("scores")


def apply_best(records: DataFrame, candidates: DataFrame, key: str, name: str, score: str, fallback: str, least: float) -> DataFrame:
    """``(key, label, score)``: each record with its best candidate of at least ``least`` (ties by name), else with its own ``fallback``."""
    ok = candidates.where((F.col(score) >= least) & F.col(name).isNotNull())
    best = ok.groupBy(F.col(key).alias("_k")).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("b"))
    return records.join(best, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("b.n", fallback).alias("label"), (-F.col("b.s")).alias("score"))


def merged_candidates(*passes: DataFrame) -> DataFrame:
    """Candidates ``(record, name, score)`` of several passes as one: of each (record, name) the best score, ranked by it."""
    all_ = reduce(DataFrame.unionByName, passes)
    best = all_.groupBy("record", "name").agg(F.max("score").alias("score"))
    return top_n(best, "record", "score", "name", 1_000_000)
