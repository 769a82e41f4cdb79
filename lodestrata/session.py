"""Session helpers: local builder, table reader, checkpoint folder and size-checked broadcast."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LODESTRATA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that Python tasks find it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha1(b"".join(f.read_bytes() for f in files)).hexdigest()[:12]
    path = Path(SparkFiles.getRootDirectory()) / f"lodestrata-{digest}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._lodestrata_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where none is set a local session gets a temporary one (tests); a
    cluster, whose executors don't see the driver's disk, must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestrata-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: cuts lineage and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint only when it has at most ``max_rows`` rows, else with a sort-merge hint: estimates know nothing
    of what explode or Python add, and would broadcast unawares. The count reads no more than the bound."""
    few = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= max_rows
    return F.broadcast(df) if few else df.hint("merge")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], times: str, hot_share: int = 8_000) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row a key, which says in ``times`` how many rows have the key.

    Keys of more than one in ``hot_share`` rows are broadcast (there can be no more than ``hot_share`` of them), so that no hot key
    is left in the shuffle by which the other rows meet the rest. Null keys meet nothing.
    """
    table = checkpointed(table)
    total = table.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) > total / hot_share
    met = rows.join(F.broadcast(table.where(hot).drop(times).withColumn("_hot", F.lit(True))), keys, "left")
    rest = met.where("_hot IS NULL").select(*rows.columns).join(table.where(~hot).drop(times).hint("merge"), keys)
    return met.where("_hot").drop("_hot").unionByName(rest)


def small_list(df: DataFrame, max_rows: int, what: str = "rows") -> DataFrame:
    """``df`` with a broadcast hint, for joins that have no other way; more than ``max_rows`` rows raise."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} {what}")
    return F.broadcast(df)


def input_partitions(spark: SparkSession, per_core: int = 3) -> int:
    """Partitions for Python-bound stages: a few for every core, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
