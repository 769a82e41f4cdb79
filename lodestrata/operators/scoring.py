"""Scoring of an extracted table against a truth, cell by cell, in four tiers; leaderboards, quality and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.censored import BELOW_DETECTION
from lodestrata.operators.relational import with_position

#: Weights of the tiers (metadata, numbers, structure, nulls) and the tolerance on a zero truth.
TIER_WEIGHTS = (0.30, 0.40, 0.15, 0.15)
ZERO_TOLERANCE = 0.001
#: Elements that may reach percents, and the ceilings of the plausibility check.
MAJOR_ELEMENTS = ["fe", "si", "al", "ca", "mg", "na", "k", "ti", "mn", "p", "s"]
MAJOR_CEILING, TRACE_CEILING = 1_000_000.0, 100_000.0


def numeric_score(pred: Column, truth: Column, tol: float = 0.05) -> Column:
    """1 within ``tol`` of relative error, 0 from 20 times that on, linear between; on a zero truth 1 if nearly zero."""
    err = F.abs(pred - truth) / F.abs(F.nullif(truth, F.lit(0.0)))
    return (
        F.when(truth == 0, (F.abs(pred) <= ZERO_TOLERANCE).cast("double"))
        .when(err <= tol, 1.0)
        .when(err >= tol * 20, 0.0)
        .otherwise(1.0 - (err - tol) / (tol * 19))
    )


def tier2(pred: Column, truth: Column, tol: float = 0.05) -> Column:
    """Score of a cell whose truth is given (null where it isn't): only the exact sentinel counts as below detection."""
    bdl_t, bdl_p = truth == BELOW_DETECTION, pred == BELOW_DETECTION
    return F.when(
        truth.isNotNull(),
        F.when(bdl_t, F.when(pred.isNull(), 0.5).when(bdl_p, 1.0).otherwise(0.3))
        .when(pred.isNull() | bdl_p, 0.0)
        .otherwise(numeric_score(pred, truth, tol)),
    )


def tier4(pred: Column, truth: Column) -> Column:
    """Score of a cell whose truth is null (null where it isn't): 1 if nothing was invented."""
    return F.when(truth.isNull(), pred.isNull().cast("double"))


def align_cells(pred: DataFrame, truth: DataFrame, keys: list[str], elements: list[str]) -> DataFrame:
    """Full outer alignment of two wide tables on ``keys`` as ``(keys, element, pred, truth, in_pred, in_truth)``.

    Wide rows are joined once and only then unpivoted, so the shuffle carries rows, not cells.
    """
    p = pred.select(*keys, F.struct(*[F.col(e).cast("double").alias(e) for e in elements]).alias("_p"))
    t = truth.select(*keys, F.struct(*[F.col(e).cast("double").alias(e) for e in elements]).alias("_t"))
    both = p.join(t, keys, "full_outer")
    cells = F.array(*[F.struct(F.lit(e).alias("element"), F.col(f"_p.{e}").alias("pred"), F.col(f"_t.{e}").alias("truth")) for e in elements])
    return both.select(*keys, F.col("_p").isNotNull().alias("in_pred"), F.col("_t").isNotNull().alias("in_truth"), F.explode(cells).alias("c")).select(
        *keys, "c.element", "c.pred", "c.truth", "in_pred", "in_truth"
    )


def report_scores(cells: DataFrame, sample_keys: list[str], report_keys: list[str], tol: float = 0.05) -> DataFrame:
    """Mean of per-sample means for tiers 2 and 4 over matched samples; a sample without cells of a tier counts 1 there."""
    scored = cells.where("in_pred AND in_truth").select(*sample_keys, tier2(F.col("pred"), F.col("truth"), tol).alias("s2"), tier4(F.col("pred"), F.col("truth")).alias("s4"))
    samples = scored.groupBy(*sample_keys).agg(F.coalesce(F.avg("s2"), F.lit(1.0)).alias("t2"), F.coalesce(F.avg("s4"), F.lit(1.0)).alias("t4"))
    return samples.groupBy(*report_keys).agg(F.avg("t2").alias("t2"), F.avg("t4").alias("t4"), F.count(F.lit(1)).alias("samples"))


def evaluation(pred: DataFrame, truth: DataFrame, sample_keys: list[str], report_keys: list[str], elements: list[str], metadata: list[str], tol: float = 0.05) -> DataFrame:
    """``(report, samples, t1..t4, overall)``: two wide tables met on ``sample_keys`` and scored by report.

    Tier 1 is the mean over the metadata fields of the share of matched samples whose truth is given and agrees but for case (0
    without any), tier 3 the F1 of the matched samples, tiers 2 and 4 means of sample means (0 without a matched sample). The two
    tables meet once, in one full outer join of wide rows; a sample's scores are made of its own row without another shuffle, and
    reports add up map-side. Repeated keys pair off with each other; null keys match nothing. Values are rounded to six places.
    """
    side = lambda df, n: df.select(*sample_keys, F.struct(*[F.col(e).cast("double").alias(e) for e in elements], *metadata).alias(n))
    both = side(pred, "_p").join(side(truth, "_t"), sample_keys, "full_outer")
    in_p, in_t = F.col("_p").isNotNull(), F.col("_t").isNotNull()
    both_in = in_p & in_t

    def mean(score, given) -> Column:
        # written out an element, so that it stays in generated code; a cell is scored in a tier just if its truth is, or isn't, given
        pairs = [(F.col(f"_p.{e}"), F.col(f"_t.{e}")) for e in elements]
        n = sum(given(t).cast("int") for _, t in pairs)
        total = sum(F.coalesce(score(p, t).cast("double"), F.lit(0.0)) for p, t in pairs)
        return F.when(both_in, F.when(n > 0, total / n).otherwise(1.0))

    same = {f: F.when(in_p & in_t & F.col(f"_t.{f}").isNotNull(), (F.lower(f"_t.{f}") == F.lower(F.coalesce(f"_p.{f}", F.lit("")))).cast("double")) for f in metadata}
    per = both.select(
        *report_keys, in_p.alias("_in_p"), in_t.alias("_in_t"), mean(lambda p, t: tier2(p, t, tol), lambda t: t.isNotNull()).alias("_s2"),
        mean(tier4, lambda t: t.isNull()).alias("_s4"), *[x.alias(f"_m_{f}") for f, x in same.items()],
    )
    agg = per.groupBy(*report_keys).agg(
        F.count("_s2").alias("samples"), F.count_if("_in_p").alias("_np"), F.count_if("_in_t").alias("_nt"), F.coalesce(F.avg("_s2"), F.lit(0.0)).alias("_t2"), F.coalesce(F.avg("_s4"), F.lit(0.0)).alias("_t4"),
        *[F.avg(f"_m_{f}").alias(f"_m_{f}") for f in metadata],
    )
    fields = F.array_compact(F.array(*[F.col(f"_m_{f}") for f in metadata]))
    t1 = F.when(F.size(fields) > 0, F.aggregate(fields, F.lit(0.0), lambda a, x: a + x) / F.size(fields)).otherwise(0.0)
    t3 = precision_recall_f1(F.col("samples"), F.col("_np"), F.col("_nt"))[2]
    name = F.col(report_keys[0]) if len(report_keys) == 1 else F.struct(*report_keys)
    tiers = agg.select(name.alias("report"), "samples", t1.alias("a"), F.col("_t2").alias("b"), t3.alias("c"), F.col("_t4").alias("d"))
    whole = overall(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return tiers.select("report", "samples", *[F.round(x, 6).alias(n) for x, n in (("a", "t1"), ("b", "t2"), ("c", "t3"), ("d", "t4"))], F.round(whole, 6).alias("overall"))


def batch_summary(scores: DataFrame, measures: list[str], places: int = 4) -> DataFrame:
    """One row: reports, samples and the unweighted mean of each measure over the reports."""
    return scores.agg(F.count(F.lit(1)).alias("reports"), F.sum("samples").alias("samples"), *[F.round(F.avg(m), places).alias(m) for m in measures])


def best_key_pair(pred: DataFrame, truth: DataFrame, report_keys: list[str], pred_columns: list[str], truth_columns: list[str]) -> DataFrame:
    """``(report keys, pred_key, truth_key, matched, f1)``: of all pairs of id columns the one with most common ids, then the best F1, then the first.

    Ids are compared trimmed and in lower case, each once a report; blank ones are none. All columns of a side are one exploded
    table, so the pairs come out of one join on (report, id) instead of one join a pair.
    """

    def ids(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(i).alias("c"), F.lower(F.trim(c)).alias("k")) for i, c in enumerate(columns)])
        return df.select(*report_keys, F.explode(listed).alias("x")).select(*report_keys, F.col("x.c").alias(name), F.col("x.k").alias("k")).where("k != ''").distinct()

    p, t = ids(pred, pred_columns, "_p"), ids(truth, truth_columns, "_t")
    met = p.join(t, [*report_keys, "k"]).groupBy(*report_keys, "_p", "_t").agg(F.count(F.lit(1)).alias("m"))
    n_p, n_t = (df.groupBy(*report_keys, c).agg(F.count(F.lit(1)).alias(n)) for df, c, n in ((p, "_p", "np"), (t, "_t", "nt")))
    reports = n_p.select(*report_keys).unionByName(n_t.select(*report_keys)).distinct()
    pairs = reports.select(*report_keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_p"), F.lit(j).alias("_t")) for i in range(len(pred_columns)) for j in range(len(truth_columns))])).alias("x")).select(*report_keys, "x.*")
    full = pairs.join(n_p, [*report_keys, "_p"], "left").join(n_t, [*report_keys, "_t"], "left").join(met, [*report_keys, "_p", "_t"], "left").na.fill(0, ["np", "nt", "m"])
    full = full.where("np > 0 OR nt > 0")
    f1 = F.round(precision_recall_f1(F.col("m"), F.col("np"), F.col("nt"))[2], 6)
    best = full.withColumn("f1", f1).groupBy(*report_keys).agg(F.max(F.struct("m", "f1", (-F.col("_p")).alias("_p"), (-F.col("_t")).alias("_t"))).alias("b"))
    at = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (1 - F.col(f"b.{c}")).cast("int"))
    return best.select(*report_keys, at(pred_columns, "_p").alias("pred_key"), at(truth_columns, "_t").alias("truth_key"), F.col("b.m").alias("matched"), F.col("b.f1").alias("f1"))


def precision_recall_f1(matched: Column, n_pred: Column, n_truth: Column) -> tuple[Column, Column, Column]:
    """Zero predictions give precision 0, an empty truth recall 1."""
    p = F.when(n_pred > 0, matched / n_pred).otherwise(0.0)
    r = F.when(n_truth > 0, matched / n_truth).otherwise(1.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def overall(t1: Column, t2: Column, t3: Column, t4: Column) -> Column:
    return sum(w * t for w, t in zip(TIER_WEIGHTS, (t1, t2, t3, t4)))


def leaderboard(scores: DataFrame, by: str, name: str) -> DataFrame:
    """1-based rank by descending score, ties by name. ``scores`` is one row a competitor: small by nature."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), name)))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, filled, share)`` of each column in one aggregation."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)])
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(columns)])
    return agg.select("n", F.explode(items).alias("x")).select(
        "x.column_name", "x.filled", F.when(F.col("n") > 0, F.col("x.filled") / F.col("n")).otherwise(0.0).alias("share")
    )


def plausibility(cells: DataFrame) -> DataFrame:
    """Per element: is every real value (below-detection marks set aside) under its ceiling? All-censored elements pass."""
    real = F.when(F.col("value") >= 0, F.col("value"))
    ceiling = F.when(F.col("element").isin(*MAJOR_ELEMENTS), MAJOR_CEILING).otherwise(TRACE_CEILING)
    by = cells.where("value IS NOT NULL").groupBy("element").agg(F.max(real).alias("max_value"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("plausible", F.coalesce(F.col("max_value") <= ceiling, F.lit(True)))


def agreement(votes: DataFrame, item: list[str], value: str, voters: int) -> DataFrame:
    """Share of the most frequent non-null value of each item among all ``voters``, rounded to one decimal of a percent."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*item, value).agg(F.count(F.lit(1)).alias("_votes"))
    return counts.groupBy(*item).agg(F.max("_votes").alias("votes")).withColumn("agreement", F.round(100.0 * F.col("votes") / F.lit(voters), 1))


def ranking_metrics(scores: DataFrame, record: str, option: str, score: str, truth: str) -> DataFrame:
    """Top-1, top-5 and mean reciprocal rank; ties count against the truth: its rank is how many score at least as much."""
    true_score = F.max(F.when(F.col(option) == F.col(truth), F.col(score)))
    per = scores.groupBy(record).agg(true_score.alias("t"), F.collect_list(score).alias("all"))
    ranks = per.where("t IS NOT NULL").select(F.size(F.filter("all", lambda x: x >= F.col("t"))).alias("rank"))
    return ranks.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("top1"),
        F.avg((F.col("rank") <= 5).cast("double")).alias("top5"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
    )


def average_precision(scores: DataFrame, option: str, score: str, record: str, relevant: str) -> DataFrame:
    """``(option, n, ap)``: mean over a class's items of (i / rank of the i-th), items ranked by the class's score, ties by record.

    Ranks come from positions in one order of all rows less the place where the class begins, so no class is one task.
    """
    placed = with_position(scores.select(option, score, record, relevant), [F.col(option), F.desc(score), F.col(record)], "_at")
    starts = placed.groupBy(option).agg(F.min("_at").alias("_start"))
    hits = with_position(placed.where(F.col(relevant)).select(option, "_at"), [F.col("_at")], "_k")
    firsts = hits.groupBy(option).agg(F.min("_k").alias("_first"))
    per = hits.join(starts, hits[option].eqNullSafe(starts[option])).select(hits[option], "_at", "_k", "_start")
    per = per.join(firsts, per[option].eqNullSafe(firsts[option])).select(per[option], ((F.col("_k") - F.col("_first") + 1) / (F.col("_at") - F.col("_start") + 1)).alias("_p"))
    return per.groupBy(option).agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("ap"))


def precision_at(scores: DataFrame, option: str, score: str, record: str, relevant: str, k: int = 50) -> DataFrame:
    """``(option, hits, precision)``: share of relevant items among each class's best ``k``, ties by record; fewer than k count as they are.

    A limit on the rank is pushed before the shuffle, so a class sends at most k rows a task.
    """
    w = Window.partitionBy(option).orderBy(F.desc(score), record)
    best = scores.select(option, score, record, relevant).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy(option).agg(F.count_if(F.col(relevant)).alias("hits"), F.avg(F.col(relevant).cast("double")).alias("precision"))
