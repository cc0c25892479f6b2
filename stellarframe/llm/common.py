"""What the corpus operators share: scratch tables in the shared folder, connected components, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    set_dir = spark.sparkContext.getCheckpointDir()
    if not set_dir:
        own = tempfile.mkdtemp(prefix="stellarframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's scratch folder, which is removed when the driver's Python ends."""
    home = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(remove, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


_HOMES: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, as far as the session still can."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])).parquet(path), path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives the loss of any executor."""
    return _written(df, name)[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Lower the session's rows of an Arrow batch, so that batches of long texts stay small beside the heap; never raised.

    The setting stays: what the operators return is lazy and runs later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows at most, whatever the session's setting, so that little is in Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges; component is the smallest id reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder. Minima are partial
    aggregates and the joins are plain equi-joins, so a node with very many links is split by AQE, not gathered.
    Self-links, nulls and repeated links have no effect. Ids must be integers.
    """
    now, path = _written(edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, fresh_path = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(now.sparkSession, path)
        was, seen, now, path = seen, mark(after), after, fresh_path
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def salted(many: DataFrame, one: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """many joined with one on key, of which one has a row for each: a key's rows of many are dealt to `salts` tasks by the column
    `by`, so a key that holds very many rows does not meet in one."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(3)), F.lit(salts)))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"]).drop("_salt")


def ranked(df: DataFrame, group: str, key: Column, order: list, name: str, buckets: int | Column = 256) -> DataFrame:
    """Add name: a gapless rank from 0 within group, without ever gathering a group in one task.

    Rows of a group are dealt to buckets by a hash of key; only bucket counts are summed up in order. Rows with one
    key share a bucket and are told apart by order. buckets is how many there are, by group if it is a column.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit(7)), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("long"))
    counts = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)).cast("long") - 1
    out = df.withColumn("_rank", rank)
    out = out.join(starts, out[group].eqNullSafe(starts["_group"]) & (out["_bucket"] == starts["_at"]))
    return out.withColumn(name, F.col("_before") + F.col("_rank")).drop("_bucket", "_rank", "_group", "_at", "_before")
