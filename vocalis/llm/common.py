"""Shared scratch tables, batch sizes and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; keep a batch of long documents far below a worker's memory.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []
_C = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="vocalis-"))
        found = _local[0]
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session is already gone
            return


atexit.register(_sweep)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns a reader of it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        drop_path(df.sparkSession, path)


def mark() -> int:
    """A place in the list of scratch tables, for clean()."""
    return len(_made)


def clean(since: int, *keep: DataFrame) -> None:
    """Removes the scratch tables made since a mark but for those kept, which results still read."""
    kept = {getattr(k, "_scratch", None) for k in keep}
    for spark, path in _made[since:]:
        if path not in kept:
            drop_path(spark, path)
    _made[since:] = [m for m in _made[since:] if m[1] in kept]


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives freed memory back to the system; Python workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Frees what ended queries hold in the driver: Python's frames in cycles keep their plans and broadcasts alive in the
    JVM, whose collector gives memory back to the system when it is asked. Executors do the same, see settle_executors().
    Runs no Python on the executors, so that stages of DataFrame functions only stay so."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
    if not _one_process(spark):
        settle_executors(spark)


def settle_executors(spark: SparkSession) -> None:
    """A task for each core, without Python: a heap that has grown for one query stays as large beside the Python workers
    of the next one until a full collection."""
    _each_core(spark).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def settle_workers(spark: SparkSession) -> None:
    """The same for the executors' Python workers, which keep what they freed in small pieces: for stages that run Python."""
    if not _one_process(spark):
        _each_core(spark).mapInArrow(_settled, "id long").write.format("noop").mode("overwrite").save()


def _one_process(spark: SparkSession) -> bool:
    """Whether the driver is the executor."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def _each_core(spark: SparkSession) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, cores, 1, cores)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches
    gc.collect()
    release()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives freed memory back when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that have one of these names, whatever their case."""
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in names])


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def caseless(text: Column) -> Column:
    """A stand-in for text with A-Z lower-cased, equal exactly when that is equal.

    The UTF-8 bytes are read as Latin-1 and lower-cased. Lead bytes C3 to DE become E3 to FE, but the number of
    continuation bytes after them still tells them apart, so no two different texts meet. Much faster than translate().
    """
    return F.lower(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))
