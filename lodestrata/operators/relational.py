"""A small null-safe relational library: joins, bag union, first-per-key, counts, gather, ordered access by position.

Order-sensitive operators take an explicit order; ties beyond it are settled by the remaining columns where rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import checkpointed, input_partitions


def join_nullsafe(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys. On clashing column names the left one stays, the right one goes.

    ``how``: inner, left, full, left_semi or left_anti. Many-to-many; an empty side behaves as in SQL.
    """
    own = {c.lower() for c in left.columns}
    renamed = right.select(F.col(f"`{right_key}`").alias("_rk"), *[F.col(f"`{c}`") for c in right.columns if c.lower() not in own and c != right_key])
    extra = [] if right_key.lower() in own or how in ("left_semi", "left_anti") else [F.col("_rk").alias(right_key)]
    joined = left.join(renamed, left[left_key].eqNullSafe(renamed["_rk"]), how)
    return joined.select("*", *extra).drop("_rk") if how not in ("left_semi", "left_anti") else joined


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by name; a column missing on one side is null there. A column of two types raises."""
    kinds: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            if kinds.setdefault(c, t) != t:
                raise ValueError(f"column {c} is {kinds[c]} in one table and {t} in another")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (nulls form a key of their own), by a map-side combining aggregate.

    ``order`` columns must make ties harmless; ties go to the row with the smallest other values.
    """
    rest = [c for c in df.columns if c not in keys]
    entry = F.struct(F.struct(*order).alias("_o"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_v"))
    return df.groupBy(*keys).agg(F.min(entry).alias("_m")).select(*keys, *[F.col(f"_m._v.`{c}`").alias(c) for c in rest]).select(*df.columns)


def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def gather(df: DataFrame, key: str, value: str, order: list[str], into: str) -> DataFrame:
    """Non-null values of each key as a list in the given order; a key with only nulls disappears."""
    item = F.struct(*[F.col(o) for o in order], F.col(value).alias("_value"))
    lists = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: x["_value"]).alias(into))


def with_position(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """0-based position of each row in an order, without one task for all rows: offsets of range partitions are added up.

    The ranges are drawn once, into the checkpoint folder, so that the counts are of the very partitions the rows stand in. Rows
    equal in the order stand in that of a hash of all their columns, so that a value which holds many rows is split as well; equal
    rows are one like the other. Only the count of each range is held in one place. An empty table stays empty.
    """
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    by = [*order, F.xxhash64(*[F.col(f"`{c}`") for c in plain])]
    ranged = df.repartitionByRange(input_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    ranged = checkpointed(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_b"))
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    # one row a partition
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.coalesce("_b", F.lit(0)) + within).drop("_p", "_m", "_b")


def select_by_index(df: DataFrame, order: list[Column], index: list[int], fields: list[str]) -> DataFrame:
    """Rows by position in ``order``; positions may repeat or be out of order, places past the end give nothing."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(index)], "out_pos int, row_index bigint")
    return with_position(df, order).join(F.broadcast(wanted), "row_index").select("out_pos", *fields)


def stable_sort(df: DataFrame, keys: list[Column], tie: list[str]) -> DataFrame:
    return df.orderBy(*keys, *tie)


def set_sides(left: DataFrame, right: DataFrame, column: str, only_left: str = "left", only_right: str = "right") -> DataFrame:
    """``(column, side)`` of each distinct non-null value: on which side it stands, 'both' for the intersection."""
    tagged = lambda df, n: df.select(F.col(column), F.lit(n).alias("_n")).where(F.col(column).isNotNull()).distinct()
    both = tagged(left, 1).unionByName(tagged(right, 2)).groupBy(column).agg(F.sum("_n").alias("_n"))
    return both.select(column, F.when(F.col("_n") == 3, "both").when(F.col("_n") == 1, only_left).otherwise(only_right).alias("side"))


def column_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(column_name, side)`` of all columns of two tables: 'both', 'left' or 'right'. Schemas are read, no row is."""
    a, b = set(left.columns), set(right.columns)
    rows = [(c, "both" if c in a and c in b else "left" if c in a else "right") for c in sorted(a | b)]
    return left.sparkSession.createDataFrame(rows, "column_name string, side string")
