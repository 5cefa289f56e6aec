"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else is part of a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: What a Python function gets at once, so that its memory doesn't follow Spark's batches of rows.
BATCH_BYTES = 4 << 20
ARROW_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session without that setting, as in
    tests, gets a folder of this machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return where


def shared(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df` marked for broadcast if its counted `rows` are at most `most`; else left to a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def tidy() -> None:
    """Give a Python worker's freed memory back; workers stay for other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session gets ROWS in an Arrow batch where it still has Spark's default: texts are long rows, and the
    buffers of every task hold a whole batch."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_ROWS, "10000") == "10000":
        conf.set(ARROW_ROWS, str(ROWS))
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: `make()` returns the function of a batch, which has about BATCH_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            step = max(1, b.num_rows * BATCH_BYTES // max(1, b.nbytes))
            for i in range(0, b.num_rows, step):
                yield f(b.slice(i, step))
        del f
        tidy()

    return small_batches(df).mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building their array."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of spans in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
