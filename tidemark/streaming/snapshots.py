"""Snapshots as a stream (an addition: the batch operators have no streaming counterpart to match).

Range windows over calendar days are not available on streams, so a stream only keeps the table up to date: late and
repeated rows are dropped within the watermark, and each batch is merged into the table by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.windows import pick


def deduplicated(stream: DataFrame, key: list[str], time: str, late: str = "7 days") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, time: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts by day of the session's time zone. Windows begin at midnight of UTC, so they are laid over times moved to the
    zone's wall clock, and a window's day is read off in UTC again."""
    zone = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    local = stream.withColumn("_local", F.from_utc_timestamp(F.col(time).cast("timestamp"), zone)).withWatermark("_local", late)
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return local.groupBy(F.window("_local", "1 day"), by).agg(F.count("*").alias("n")).select(day.alias("day"), by, "n")


def upsert(stream: DataFrame, table: str, key: list[str], newest: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Merges each batch into a Parquet table: the newest row of a key stays.

    A batch writes its own rows alone, as ``part-<number>``; each ``every`` batches the table is written anew as
    ``base-<number>``, and what stands before the previous base is deleted. A folder counts once it is complete, so a failed
    batch can be run again. ``current`` reads the last base and the parts behind it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pick(batch, key, [F.desc(newest)]).write.mode("overwrite").parquet(f"{table}/part-{number:012d}")
        bases, parts = _complete(spark, table)
        last = max((n for n in bases if n < number), default=-1)
        if sum(last < n <= number for n in parts) >= every:
            current(spark, table, key, newest, number).write.mode("overwrite").parquet(f"{table}/base-{number:012d}")
            where, fs = _fs(spark, table)
            for kind, numbers in (("base", bases), ("part", parts)):
                for n in numbers:
                    if n < last or (kind == "part" and n <= last):
                        fs.delete(_fs(spark, f"{table}/{kind}-{n:012d}")[0], True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, table: str) -> tuple[list[int], list[int]]:
    """Numbers of the complete bases and parts."""
    where, fs = _fs(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    found = {"base": [], "part": []}
    for name in sorted(names):
        kind, _, number = name.partition("-")
        if kind in found and fs.exists(_fs(spark, f"{table}/{name}/_SUCCESS")[0]):
            found[kind].append(int(number))
    return found["base"], found["part"]


def current(spark: SparkSession, table: str, key: list[str], newest: str, upto: int | None = None) -> DataFrame | None:
    """The table, as of a batch if that is given; None before the first batch."""
    bases, parts = _complete(spark, table)
    last = max((n for n in bases if upto is None or n < upto), default=None)
    folders = [f"{table}/base-{last:012d}"] if last is not None else []
    folders += [f"{table}/part-{n:012d}" for n in parts if (last is None or n > last) and (upto is None or n <= upto)]
    if not folders:
        return None
    return pick(spark.read.parquet(*folders), key, [F.desc(newest)])
