"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: words are runs of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from the session; a temporary one only in local mode, where there is one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def _place(spark: SparkSession, path: str):
    """The path and its file system, as the driver's Hadoop client knows them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A folder that is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    return path


def settled(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        place, system = _place(df.sparkSession, df.settled_at)
        system.delete(place, True)


def worker_cache(key: str, make):
    """An object kept by this Python worker over its tasks; another key's object goes, so a worker holds one."""
    kept = sys.modules.setdefault("tidemark_worker_cache", types.ModuleType("tidemark_worker_cache"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.value = key, None
        kept.value = make()
    return kept.value


def slices(batches, size: int = 4_000_000):
    """Record batches in slices of about so many bytes. At the end the worker, which Spark keeps, gives its free memory back."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(size, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    del batches
    trim()


def trim() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done: it does so once the driver has collected their objects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a table of a few numbers each that are broadcast (some 10 MB); a larger one is joined by an exchange.
BROADCAST_ROWS = 200_000


#: The same for the items of a column of lists of a few numbers each.
BROADCAST_ITEMS = 3_000_000


def small(df: DataFrame, lists: str | None = None) -> DataFrame:
    """df (cheap to count; a few numbers a row, and perhaps a column of lists of such), to be broadcast if it has no more rows and items than these."""
    items = F.lit(0) if lists is None else F.sum(F.size(lists))
    r = df.agg(F.count(F.lit(1)).alias("rows"), items.alias("items")).first()
    return F.broadcast(df) if r["rows"] <= BROADCAST_ROWS and (r["items"] or 0) <= BROADCAST_ITEMS else df


#: A key with more than this share of a table's rows is hot; there are fewer hot keys than 1 / HOT.
HOT = 1 / 1000


def unskewed_join(many: DataFrame, one: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The left join of many (settled) with one (settled; a row for each key, `rows` telling how many of many's rows have it).

    Hot keys, fewer than 1 / HOT, are joined by broadcast, the others by an exchange in which no key is large.
    """
    total = one.agg(F.sum(rows).alias("n")).first()["n"] or 0
    hot = F.broadcast(one.where(F.col(rows) > total * HOT))
    cold = many.join(hot.select(*on), on, "left_anti").join(one.where(F.col(rows) <= total * HOT), on, "left")
    return many.join(hot, on).unionByName(cold).drop(rows)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words; empty for null or blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RE))


def n_words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RE))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for the row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) in the order given, by a range exchange and the sizes of its partitions: no task holds all rows.

    The order must tell apart all rows for which a rerun has to agree.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settled(spread.withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p], total = total, total + n
    starts = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_p long, _start long")
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_i")).drop("_m", "_p", "_i", "_start")
