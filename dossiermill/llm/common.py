"""Helpers shared by the training-data operators: table access, materialised
intermediate tables, a spread row order with gapless ranks, and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.
    Only a local master, whose tasks run in the driver's process, may do without one
    and gets a temporary folder; anywhere else a missing setting is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="dossiermill-"))
    return sc.getCheckpointDir()


#: With this set, Spark deletes the shuffle files of a plan as soon as the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.
    Cuts the lineage, survives lost executors and is compressed. The shuffle files that
    this took are deleted, which otherwise waits for the driver's garbage collector."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote and that no later plan reads. What a returned
    plan still reads stays in the shared folder, whose owner clears it."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)


#: Rows of an Arrow batch where rows hold whole texts. A batch and what is made of it
#: live in an executor's memory beside Spark's own, for each task that runs there.
TEXT_ROWS = 1_000
SMALL_ROWS = 10_000
#: Keys with so many rows or fewer are never cut into parts.
LEAST_SHARE = 256


def batch_rows(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Sets how many rows the plans made from now on pass to Python at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


#: Edges that a task of a round takes.
EDGES = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected ``edges`` (u, v), root =
    smallest node. Alternating large-star and small-star rounds, every round a
    shuffle of the edges only; ends when a round changes nothing. Nodes without
    an edge are not listed. A round has as many tasks as its edges need and not as
    many as the shuffles of whole documents."""
    edges = stored(_directed(edges))
    tasks = min(parallelism(edges.sparkSession), -(-edges.count() // EDGES))
    same = not tasks
    while not same:
        turned = stored(_star(_star(edges, tasks, large=True), tasks, large=False))
        signed = turned.withColumn("n", F.lit(1)).unionByName(edges.withColumn("n", F.lit(-1)))
        same = signed.groupBy("u", "v").agg(F.sum("n").alias("n")).coalesce(tasks).where("n <> 0").isEmpty()
        discard(edges)
        edges = turned
    roots = edges.groupBy("u").agg(F.min("v").alias("v")).coalesce(max(1, tasks))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().coalesce(max(1, tasks))
    )


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, tasks: int, large: bool) -> DataFrame:
    """One star round. Large: every larger neighbour of u is linked to the least
    of u's neighbourhood; small: every smaller-or-equal one, and u itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
    linked = both.where("v > u") if large else both
    out = linked.join(least, "u").coalesce(tasks).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return _directed(out).coalesce(tasks)


def spread_join(big: DataFrame, small: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """``big`` inner-joined with ``small``, which has a key at most a few times. Keys
    with more than an even share of the rows of ``big`` (fewer keys than there are
    shuffle partitions, so a bounded list) are cut into as many parts as they have even
    shares, and their rows of ``small`` are repeated for each part. A row's part is a
    hash of the row, so a task that runs again deals alike. ``counted`` is a cheaper
    table with the same keys as often as ``big``."""
    parts = parallelism(big.sparkSession)
    counted = big if counted is None else counted
    total = counted.count()
    share = max(LEAST_SHARE, -(-total // parts))
    counts = counted.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > share).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    if total <= share or not (found := hot.collect()):
        return big.join(small, key)
    hot = F.broadcast(big.sparkSession.createDataFrame(found, hot.schema))
    one = F.coalesce("_parts", F.lit(1))
    names = [c for c in small.columns if c != key]
    left = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(*big.columns), one).cast("int"))
    right = small.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1)))
    return left.join(right.select(key, "_part", *names), [key, "_part"]).select(key, *(c for c in big.columns if c != key), *names)


def spread_starts(df: DataFrame, group: list[str], amount: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the column ``name``: the sum of ``amount`` over the rows of the
    same ``group`` that come before, in the order of MD5(doc_id), doc_id, ties.

    Two levels, so that no group is ever in one task: each group is cut into ranges
    of the hash; sums of the ranges, a table of as many rows as groups times shuffle
    partitions, give each range its start, and a window runs inside each range."""
    ranges = parallelism(df.sparkSession)
    place, cell, part, base = fresh(df, "_order", "_range", "_sum", "_base")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    first = F.conv(F.substring(place, 1, 8), 16, 10).cast("long")
    rows = df.withColumn(place, order).withColumn(cell, F.floor(first * ranges / F.lit(1 << 32)).cast("int"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, cell).agg(F.sum(amount).alias(part))
    sums = sums.select(*group, cell, F.coalesce(F.sum(part).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(*group, cell).orderBy(place, "doc_id", *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(amount).over(within), F.lit(0))
    out = rows.join(sums, [*group, cell]).withColumn(name, (F.col(base) + own).cast("long"))
    return out.select(*df.columns, name)
