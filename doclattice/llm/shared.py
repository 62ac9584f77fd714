"""Helpers that several operators of this subpackage use.

Nothing here keeps state on one machine: tables that cut a lineage go to the folder which the
cluster names in ``spark.checkpoint.dir``, so that a lost executor costs a re-read and no more.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["shared_dir", "materialize", "read_table", "partitions", "connected_components", "row_order"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, one of our own on a single machine (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="doclattice-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_delete)
    _left.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut of the lineage on reliable storage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_left: list[tuple[SparkSession, str]] = []


def _delete() -> None:
    """Removes the tables of this driver: results may be read from them until it ends."""
    for spark, path in _left:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        except Exception:  # noqa: BLE001, S112  the session has ended: the cluster clears its folder
            continue


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_order(df: DataFrame, name: str, *by: Column) -> tuple[DataFrame, dict[int, int]]:
    """Number all rows from 0 in the order ``by`` without a single-task window.

    A range exchange sorts the rows; each partition numbers its own (``_mid`` holds partition and
    offset). Only the row count of every partition (one number each) comes to the driver. Returns the
    written table with ``_part``, ``_off`` and the first number of each partition.
    """
    ordered = df.orderBy(*by).withColumn("_mid", F.monotonically_increasing_id())
    placed = ordered.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_off", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid")
    table = materialize(placed, name)
    first, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in table.groupBy("_part").count().collect()):
        first[part], total = total, total + n
    return table, first


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable node of every node: ``edges(a, b)`` of one orderable type -> ``(node, root)``.

    Hooking and pointer jumping as joins and partial aggregates: each round a node takes the smallest
    root among its own and its neighbours', each root takes the smallest that any of its members saw,
    and roots are followed one step. No group is gathered in one task, so a component may hold any share of the
    nodes; the skewed side of each join can be split at run time. Rounds grow with the logarithm of the
    longest path. Nodes without an edge don't appear; self-loops and repeats are harmless, null ends are ignored.
    """
    sym = edges.where("a is not null and b is not null")
    both = F.explode(F.expr("array(struct(a as a, b as b), struct(b as a, a as b))"))
    sym = materialize(sym.select(both.alias("e")).select("e.*").distinct(), f"{name}-edges")
    state = materialize(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = sym.join(state, sym.b == state.node).groupBy("a").agg(F.min("root").alias("seen"))
        seen = materialize(state.join(near, state.node == near.a, "left").select("node", "root", F.least("root", "seen").alias("low")), f"{name}-{step}s")
        # a root hears the smallest root that any member saw
        heard = seen.groupBy("root").agg(F.min("low").alias("to")).where("to < root")
        if not heard.take(1):
            return state
        hooked = seen.join(heard.withColumnRenamed("root", "r"), F.col("root") == F.col("r"), "left").select("node", F.least("low", "to").alias("root"))
        jump = seen.select(F.col("node").alias("n2"), F.col("low").alias("r2"))
        state = materialize(hooked.join(jump, F.col("root") == F.col("n2"), "left").select("node", F.least("root", "r2").alias("root")), f"{name}-{step}")
