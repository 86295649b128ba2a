"""Structured Streaming forms of the daily work.

Classification is stateless: ``operators.classify.classify`` runs on a stream unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import first_per_key
from ..session import written
from ..sources.tables import exists, remove, replace_days


def read_files(
    spark: SparkSession, folder: str, schema, glob: str | None = None,
    max_files: int | None = None, fmt: str = "parquet",
) -> DataFrame:
    """Stream of files below a folder; ``max_files`` caps the work of one trigger."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def run_available(
    stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Process what is there now, then stop. A restart continues at the checkpoint."""
    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(batch)
        .start()
    )


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Append, replacing the batch's own folder when the batch is retried."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert(path: str, keys: list[str], day: str) -> Callable[[DataFrame, int], None]:
    """For update mode: changed rows replace the stored ones of the same keys.

    The result is a table partitioned by ``day`` (a copy of the column of that name). Only the
    partitions of changed days are read and replaced. What a batch will put there is written
    first, below ``<path>_next``; a batch that is repeated after it began to replace partitions
    finds it there and puts the same rows.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        stage = f"{path}_next/batch={batch_id}"
        if not exists(spark, f"{stage}/_SUCCESS"):
            changed = written(df.withColumn("day", F.col(day)), "changed")
            rows = changed
            if exists(spark, path):
                days = [r["day"] for r in changed.select("day").distinct().collect()]  # of one batch
                stored = spark.read.schema(changed.schema).parquet(path).filter(F.col("day").isin(days))
                rows = stored.join(changed, keys, "left_anti").unionByName(changed)
            rows.write.mode("overwrite").parquet(stage)
        schema = T.StructType([*df.schema.fields, T.StructField("day", T.DateType())])
        replace_days(spark.read.schema(schema).parquet(stage), path)
        remove(spark, f"{path}_next/batch={batch_id - 1}")

    return write


def dedup_within(stream: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Bounded form: one row per key within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


KEY_VALUE_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def start_keyed(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose keyed state lies in RocksDB; other queries keep their provider."""
    before = {name: spark.conf.get(name, None) for name in KEY_VALUE_STATE}
    for name, value in KEY_VALUE_STATE.items():
        spark.conf.set(name, value)
    try:
        return start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def dedup_keyed(folder: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """Exact form: the first row per key of all history, by ``order`` inside a batch.

    A batch keeps one row per key in ``folder/arrived``; an inner query takes these in and looks
    each key up in its keyed state (RocksDB, written to ``folder/keys``, no expiry). So the work of a
    batch depends on its own rows, never on how much is stored. Rows with new keys are appended to
    ``folder/unique``. A batch that is repeated arrives again, and its keys are known by then.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        arrived = f"{folder}/arrived"
        first_per_key(df, keys, [order]).write.mode("overwrite").parquet(f"{arrived}/from={batch_id}")
        # files that a repeated batch has replaced are passed over; their rows come in the new ones
        rows = spark.readStream.schema(df.schema).option("ignoreMissingFiles", "true").parquet(arrived)
        fresh = rows.dropDuplicates(keys)
        start_keyed(
            spark, lambda: run_available(fresh, f"{folder}/keys", append_to(f"{folder}/unique"))
        ).awaitTermination()

    return write


def unique_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What ``dedup_keyed`` has let through."""
    return spark.read.schema(schema).parquet(f"{folder}/unique").select(*schema.fieldNames())


def tumbling_days(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Daily totals by event time; late rows update their own day until the watermark has
    passed it, which also drops the day's state."""
    return _windowed(stream.withWatermark(time, delay), F.window(time, "1 day"))


def sliding_weeks(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Trailing seven-day totals, one window ending every day."""
    return _windowed(stream.withWatermark(time, delay), F.window(time, "7 days", "1 day"))


def _windowed(stream: DataFrame, window) -> DataFrame:
    totals = stream.groupBy(window.alias("w")).agg(
        F.count("*").alias("n_articles"),
        F.count_if(F.col("risk") == 1).alias("n_risk"),
        F.count_if(F.col("opportunity") == 1).alias("n_opportunity"),
    )
    return totals.select(
        F.to_date("w.start").alias("start_day"), F.date_sub(F.to_date("w.end"), 1).alias("end_day"),
        "n_articles", "n_risk", "n_opportunity",
    )


def recompute_touched_days(
    rows_path: str, rollup_path: str, rollup: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Store the batch, then rebuild exactly the days it touches from the stored rows.

    Late rows therefore change the day they belong to, whenever they arrive. Stored rows are
    partitioned by day, so only the touched days are read back.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        target = f"{rows_path}/batch={batch_id}"
        df.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(target)
        with_batch = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
        stored = spark.read.schema(with_batch).parquet(rows_path)
        touched = stored.filter(F.col("batch") == batch_id).select("day").distinct()
        replace_days(rollup(stored.join(touched, "day", "left_semi")), rollup_path)

    return write
