"""What the operators share: input tables, shared scratch tables, global order, connected components.

Everything that outlives one job is a Parquet table in the folder the cluster names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor only costs the
tasks it was running. Nothing here collects rows, links or components to the driver.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_sent: set[str] = set()  # applications whose workers have this package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="plinth-")  # workers may ask the driver for the file at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, f"{os.path.basename(folder)}.zip")
    with zipfile.ZipFile(name, "w") as out:
        for where, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(where, f)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(name)
    _sent.add(context.applicationId)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every worker."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a new local folder if all runs on one machine, else ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="plinth-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and Path object of a path, whatever store it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)


def release(spark: SparkSession) -> None:
    """A hint to delete the shuffle files of jobs whose results are stored: Spark's cleaner does so once
    the driver's references to them are collected, which else may wait for long. No result depends on it."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out in taken:
        out += "_"
    return out


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/plinth-{tag}-{uuid.uuid4().hex[:12]}"


_stored: dict[str, list[str]] = {}  # stashed tables of each application


def _forget(context, paths: list[str]) -> None:
    """Deletes stashed tables before their application ends."""
    try:
        for path in paths:
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the driver's JVM is gone already: the shared folder's owner cleans up
        return


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a shared Parquet table and reads it back: cuts lineage, survives lost executors.

    The table stays until the application's Python driver ends, as a lazy result may read it until then.
    ``drop_stashed`` deletes it earlier.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    context = spark.sparkContext
    if context.applicationId not in _stored:
        _stored[context.applicationId] = []
        atexit.register(_forget, context, _stored[context.applicationId])
    _stored[context.applicationId].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stashed(spark: SparkSession) -> None:
    """Deletes all tables that operators stored for this application; results not yet read are lost."""
    paths = _stored.get(spark.sparkContext.applicationId, [])
    remove(spark, *paths)
    paths.clear()


def in_order(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """A stored copy of the (narrow) df with ``part``: range partitions of ascending keys.

    Rows of part p precede all of part p + 1, so a window per part plus a table of one row per part
    gives global ranks, sums and neighbours without sending all rows to one task.
    """
    ordered = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    return stash(ordered.withColumn("part", F.spark_partition_id()), tag)


def running_total(ordered: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one; ordered comes from in_order."""
    w = Window.partitionBy("part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per range partition: their number is bounded by spark.sql.shuffle.partitions
    parts = ordered.groupBy("part").agg(F.sum(value).alias("part_total"))
    base = F.coalesce(F.sum("part_total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", base.alias("part_base"))
    return ordered.withColumn("own_before", before).join(F.broadcast(parts), "part").withColumn(out, (F.col("part_base") + F.col("own_before")).cast("long")).drop("own_before", "part_base")


def neighbours(ordered: DataFrame, keys: list[str], columns: list[str], wrap: bool = False) -> DataFrame:
    """Adds ``prev`` and ``next``: structs of columns of the rows before and after in global order.

    With wrap, the row after the last is the first (and the row before the first is the last).
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    w = Window.partitionBy("part").orderBy(*order)
    item = F.struct(*columns)
    rows = ordered.withColumn("prev", F.lag(item).over(w)).withColumn("next", F.lead(item).over(w))
    key = F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)) for k in keys])
    ends = ordered.groupBy("part").agg(F.min_by(item, key).alias("first"), F.max_by(item, key).alias("last"))
    by_part = Window.orderBy("part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.lag("last").over(by_part), F.lead("first").over(by_part)
    if wrap:
        before = F.coalesce(before, F.last("last").over(everything))
        after = F.coalesce(after, F.first("first").over(everything))
    ends = ends.select("part", before.alias("before"), after.alias("after"))
    rows = rows.join(F.broadcast(ends), "part")
    return rows.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after")).drop("before", "after")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars: rows (node, root), root the least node.

    edges: two long columns, in any direction, repeats allowed. Nodes without edges are not listed.
    Distributed union-find: each round is two shuffled joins over the edges that are left; rounds grow
    with the logarithm of the longest chain. Each round is a stored table; the last but one is deleted.
    """
    spark = edges.sparkSession
    pair = F.col(a), F.col(b)
    links = edges.where(pair[0] != pair[1]).select(F.greatest(*pair).alias("u"), F.least(*pair).alias("v")).distinct()
    paths: list[str] = []

    def put(df: DataFrame) -> tuple[DataFrame, tuple]:
        paths.append(new_path(spark, "star"))
        df.write.parquet(paths[-1])
        kept = spark.read.schema("u long, v long").parquet(paths[-1])
        row = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return kept, tuple(row)

    links, seen = put(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, _ = put(large)
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        links, now = put(small)
        remove(spark, *paths[:-1])
        del paths[:-1]
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
