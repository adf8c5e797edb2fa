"""What the operators of this subpackage share: reading, cutting lineage, joins that bear hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are joined by broadcast because many rows have them: at most so many, each with over HOT_ROWS rows.
HOT_KEYS, HOT_ROWS = 512, 64
#: Rows of an Arrow batch while tables are made.
BATCH = 2000


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, one of our own, but only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known.rsplit("/", 1)[0]
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="silvaflow-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def making(spark: SparkSession) -> Iterator[None]:
    """While a table is made that is kept in the shared folder, few rows go to a Python worker at once, as rows hold whole
    texts, and the shuffles that written() took are deleted as soon as the table is there. After cut() they wait for
    release()."""
    name, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, cleaned = spark.conf.get(name), spark.conf.get(clean)
    if int(before) <= 0 or int(before) > BATCH:
        spark.conf.set(name, str(BATCH))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(clean, cleaned)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    with making(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder as compressed columns: for wide tables of which later steps read few
    columns. Spark writes a task's file under a name of the attempt, so that a lost task does no harm."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with making(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() gave and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more; it does so when the driver collects its
    garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hottest(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Of a table with one row for each key and its number of rows, the few keys with the most rows (HOT_KEYS at most)."""
    return counts.filter(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *keys).limit(HOT_KEYS)


def join_bearing_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join of rows to table, which has one row for each key and its count n: keys with many rows go by
    broadcast (HOT_KEYS rows at most), so that no task gets all rows of a hot key; the others are shuffled."""
    hot = hottest(table, keys, n).collect()
    if not hot:
        return rows.join(table, keys)
    hot_rows = table.sparkSession.createDataFrame(hot, table.schema)
    hot_keys = F.broadcast(hot_rows.select(*keys))
    return rows.join(F.broadcast(hot_rows), keys).unionByName(
        rows.join(hot_keys, keys, "left_anti").join(table.join(hot_keys, keys, "left_anti"), keys)
    )


#: Bits of the map of ids that only() broadcasts: 32 for each id, 8 MB at most, whatever the input.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def only(rows: DataFrame, needed: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) is in needed (a table that is cut or written), and some others: what a join to needed would
    drop mostly goes before the shuffle. A map with a bit for each hash of a key is broadcast; where it is full nothing is
    dropped."""
    size = max(LEAST_BITS, min(MOST_BITS, 1 << (32 * needed.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(size))
    bits = needed.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__bucket")
    power = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (bit % 8).cast("int") + 1)
    return met.filter(byte.bitwiseAND(power) != 0).select(*rows.columns)


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """What gives the free memory of the C library back to the system, where it has that."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work of a Python worker, whose memory goes back to the system when the task is over: workers stay, idle or for other
    tasks, beside all later stages of their executor."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := _malloc_trim():
            trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose texts hold at most so many bytes, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
