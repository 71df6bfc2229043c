"""Lines that are appended until there are so many, by a stream that can be stopped and taken up again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _folder(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def appended(spark: SparkSession, path: str) -> dict[int, int]:
    """batch -> lines of what append_until() has written: the folders' names say it, no file is read."""
    fs, at = _folder(spark, f"{path}/batch=*/lines=*")
    names = [str(f.getPath()).rsplit("/", 2)[1:] for f in fs.globStatus(at) or []]
    return {int(batch.removeprefix("batch=")): int(lines.removeprefix("lines=")) for batch, lines in names}


def append_until(stream: DataFrame, path: str, checkpoint: str, target: int | None = None, column: str = "line", **trigger) -> StreamingQuery:
    """Starts a query that appends a column's lines to path until it has target lines; null lines are left out.

    Each batch becomes path/batch=<number>/lines=<n>, which is renamed into place when it is whole. So a batch that is run
    again, after a crash between its write and the stream's own commit, is found there and not written twice; a batch that
    was broken off leaves nothing. Exactly target lines are written if the stream has so many; which of the last batch's, the
    order of its partitions decides. Lines are read with spark.read.text(path).
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        done = appended(spark, path)
        room = None if target is None else target - sum(done.values())
        if number in done or room is not None and room <= 0:
            return
        staged, seen = f"{path}/.batch-{number}", Observation()
        lines = batch.select(F.col(column).cast("string").alias("value")).where("value is not null")
        lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(staged)
        n = seen.get["n"]
        if room is not None and n > room:
            kept = f"{path}/.kept-{number}"
            spark.read.text(staged).limit(room).write.mode("overwrite").text(kept)
            fs, old = _folder(spark, staged)
            fs.delete(old, True)
            staged, n = kept, room
        fs, parent = _folder(spark, f"{path}/batch={number}")
        fs.mkdirs(parent)
        if not fs.rename(_folder(spark, staged)[1], _folder(spark, f"{path}/batch={number}/lines={n}")[1]):
            raise OSError(f"{staged} could not be renamed")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
