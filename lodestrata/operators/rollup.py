"""Score post-processing and statistics: softmax, hierarchical rollups, priors, per-element site statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.censored import BELOW_DETECTION


def softmax(df: DataFrame, record: list[str], score: str, name: str = "p", temperature: float = 1.0) -> DataFrame:
    """Softmax of a record's scores; if one of them isn't finite, all of them become 1/n. Null scores are left out."""
    w = Window.partitionBy(*record)
    s = F.col(score) / temperature
    finite = F.min((~F.isnan(score) & (F.abs(score) != float("inf"))).cast("int")).over(w) == 1
    e = F.exp(s - F.max(s).over(w))
    return df.where(F.col(score).isNotNull()).withColumn(name, F.when(finite, e / F.sum(e).over(w)).otherwise(1.0 / F.count(F.lit(1)).over(w)))


def rollup_max(df: DataFrame, record: str, group: str, score: str, name: str = "group_p") -> DataFrame:
    """Best member score of each group, renormalised over the record's groups."""
    best = df.groupBy(record, group).agg(F.max(score).alias("_b"))
    return best.withColumn(name, F.col("_b") / (F.sum("_b").over(Window.partitionBy(record)) + 1e-12)).drop("_b")


def top_n(df: DataFrame, record: str, score: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(record).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def site_statistics(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Analyses (below detection included), sentinels, exact median, least and greatest real value; groups without one are left out."""
    v = F.col(value)
    real = F.when(v >= 0, v)
    out = cells.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_analyses"), F.count_if(v == BELOW_DETECTION).alias("n_bdl"),
        F.round(F.median(real), 4).alias("median_ppm"), F.round(F.min(real), 4).alias("min_ppm"), F.round(F.max(real), 4).alias("max_ppm"),
    )
    return out.where("median_ppm IS NOT NULL")


def class_prior(labels: DataFrame, options: DataFrame, label: str, option: str) -> DataFrame:
    """Share and log share of every option, those never seen included."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = labels.count()
    joined = options.select(option).distinct().join(counts, F.col(option) == F.col(label), "left")
    p = F.coalesce(F.col("n"), F.lit(0)) / F.lit(max(total, 1))
    return joined.select(option, F.coalesce("n", F.lit(0)).alias("n"), p.alias("prior"), F.log(p + 1e-20).alias("log_prior"))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / (F.sum(mask) + 1e-20)


def nearest_by_cosine(queries: DataFrame, vectors: DataFrame, ident: str, vector: str, k: int, query_block: int = 8_192, vector_block: int = 65_536, places: int = 5) -> DataFrame:
    """``(q, ident, sim, rank)``: the ``k`` vectors nearest each query by cosine, itself aside, ties by id.

    Queries and vectors are hashed into blocks of bounded size and each pair of blocks is one group of a grid: no task holds more
    than two blocks, and each gives out only its best ``k`` a query. Neither side is collected. Null and zero vectors are left out.
    """
    def blocks(df: DataFrame, size: int, least: int) -> int:
        return max(least, -(-df.count() // size))

    usable = lambda df: df.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    q, e = usable(queries), usable(vectors)
    n_q, n_e = blocks(q, query_block, 1), blocks(e, vector_block, vectors.sparkSession.sparkContext.defaultParallelism)
    part = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    left = q.withColumn("a", part(n_q)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_e - 1))))
    right = e.withColumn("b", part(n_e)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        def unit(t: pa.Table) -> np.ndarray:
            m = np.stack([np.asarray(v) for v in t.column("v").to_pylist()]) if len(t) else np.empty((0, 1))
            return m / np.linalg.norm(m, axis=1, keepdims=True)

        out: list[list[np.ndarray]] = [[], [], []]
        if len(x) and len(y):
            qi, yi, qm, ym = x.column("i").to_numpy(), y.column("i").to_numpy(), unit(x), unit(y)
            for s in range(0, len(qi), 256):
                sims = np.round(qm[s : s + 256] @ ym.T, places)
                sims[qi[s : s + 256, None] == yi] = -9
                order = np.lexsort((np.broadcast_to(yi, sims.shape), -sims), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(order)), order.shape[1])
                near = sims[rows, order.ravel()]
                keep = near > -9
                for c, z in zip(out, (qi[s : s + 256][rows], yi[order.ravel()], near)):
                    c.append(z[keep])
        return pa.table([np.concatenate(c) if c else np.array([], t) for c, t in zip(out, (np.int64, np.int64, np.float64))], names=["q", ident, "sim"])

    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, f"q bigint, `{ident}` bigint, sim double")
    return top_n(near, "q", "sim", ident, k)
