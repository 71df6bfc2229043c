"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Upper bound of the bytes that one Arrow batch hands to Python, so that very long texts don't pile up.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 2000
#: Tables whose size is bounded beforehand are written in files of so many rows, and in LEAST_FILES at least.
ROWS_PER_FILE, LEAST_FILES = 50_000, 6


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where one machine is all, a temporary one stands in if it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='frameloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder; what is there goes with release(), clear() or the driver process."""
    at = f"{shared_dir(spark)}/frameloom-{tag}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    # the file system outlives the session, so that a session that is stopped first leaves nothing behind
    _written[at] = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
    return at


def materialize(df: DataFrame, tag: str, most_rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it again.

    Lost executors don't lose the table. What was shuffled for it is dropped once it is written. Where df is known to
    have most_rows at most, it is written in as few files as so many rows ask for. A half-written table can't be read: its path is
    new and known to no one until the job that writes it has been committed, so that no success marker is needed.
    The table goes with release(), clear(), or when the driver process ends.
    """
    spark = df.sparkSession
    at = new_path(spark, tag)
    if most_rows is not None and (files := max(LEAST_FILES, -(-most_rows // ROWS_PER_FILE))) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    seen = Observation()
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._frameloom_path, out._frameloom_rows = at, seen.get["n"]
    return out


def merged(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting, however small it is: tables that grow with the input are not sent to all executors, and their copies don't gather in the driver."""
    return df.hint("merge")


def rows_of(df: DataFrame) -> int:
    """How many rows a table has that materialize() wrote."""
    return df._frameloom_rows


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote; no later plan may read them."""
    for df in tables:
        _remove(df._frameloom_path)


def clear() -> None:
    """Deletes all that is left of what this process wrote to the shared folder. Results that still read it must be written before."""
    for at in list(_written):
        _remove(at)


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file to the shared folder, whatever store it is in; returns its path, whose last part is name's."""
    at = f"{new_path(spark, 'file')}/{name}"
    fs, path = _written[at.rpartition("/")[0]]
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at))
    out.write(bytearray(content))
    out.close()
    return at


_written: dict[str, tuple] = {}


def _remove(at: str) -> None:
    fs, path = _written.pop(at, (None, None))
    if fs is not None:
        fs.delete(path, True)


@atexit.register
def _at_exit() -> None:
    try:
        clear()
    except (Py4JError, OSError):  # the JVM ended first
        _written.clear()


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's caps on rows and bytes of the Arrow batches that go to Python workers, where they are higher.

    Plans are lazy and read these settings when they run, so that the caps stay after the call.
    """
    for key, most in (("maxRecordsPerBatch", ARROW_BATCH_ROWS), ("maxBytesPerBatch", ARROW_BATCH_BYTES)):
        given = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2 ... that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """df's schema and further columns."""
    return StructType([*df.schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in kinds.items())])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """fn over each Arrow batch of df, row order and partitions unchanged."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; NULL ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def sample_share(df: DataFrame, key: str, rate: float, seed: int) -> DataFrame:
    """Rows whose key hashes below rate; the same rows however the table is partitioned."""
    if rate >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(rate * (1 << 30)))
