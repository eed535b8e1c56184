"""What the operators of this folder share: reading tables, durable intermediate results, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Links that one task joins to components (some 250 MB at most); more are joined in rounds over tables.
TASK_LINKS = 1 << 21
#: Rows of a batch that such a task returns.
BATCH_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests) a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    where = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def drop(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, executors may be lost.

    No file marks success: over local files, Hadoop starts a process to set each new file's permissions.
    """
    where = scratch(df.sparkSession, label)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out.stored_at = where
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``stored`` wrote, for tables that nothing will read any more."""
    for df in tables:
        if df is not None:
            drop(df.sparkSession, df.stored_at)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, component) of all links (a, b) of a task: roots hook on to lesser roots until no link joins two."""
    found = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if not found:
        return
    ids, place = np.unique(np.concatenate([x for ends in zip(*found, strict=True) for x in ends]), return_inverse=True)
    a, b = np.split(place, 2)
    # Places follow the order of ids, so the least place of a component is that of its least id.
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    for lo in range(0, len(ids), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + BATCH_ROWS]), pa.array(ids[root[lo : lo + BATCH_ROWS]])], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links (a, b): rows (id, component), the smallest id reachable.

    Up to TASK_LINKS different links are joined in one task, which spares the driver dozens of plans. More
    go through large-star and small-star steps over written tables, in turn, until nothing changes; no step
    gathers a node's neighbours: each is a minimum per node, joined back. Ids without links don't appear.
    """
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if stars.count() <= TASK_LINKS:
        out = stored(stars.coalesce(1).mapInArrow(_joined, "id long, component long"), "components")
        discard(stars)
        return out
    last = None
    while True:
        both = stars.union(stars.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "links")
        discard(stars)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        stars = stored(small, "links")
        discard(large)
        state = stars.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == last:
            out = stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
            out.stored_at = stars.stored_at
            return out
        last = state
