"""Exact deduplication by a stateful stream.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Rows of
a stored Parquet table arrive as (id, digest, code points, content locator: file and row in it).
A streaming aggregation keyed by digest takes them in; its state lives in RocksDB, is written to
the shared folder with each batch and never expires. It retains for each digest how many rows
came and, of the row that stays so far (most code points, then smallest id), the stable
identifier and the locator. Rows of one digest are combined in each task before they are
shuffled, so that a text that a third of all rows hold reaches its key as one row a task.

A digest that came more than once is a hit. The full texts of hits are fetched from the table and
grouped by digest and all their bytes. Where one digest has several texts, each of these is
a class of its own; so a collision never joins different texts, whatever the digest is.

``arrive`` appends rows of further tables, ``absorb`` lets the stream take in what has arrived
since, ``resolve`` gives the classes of all that was taken in. A batch that is repeated after a
failure replaces its own output, and a restart goes on at the checkpoint in ``folder``.

Defined results: a null text counts as empty; empty texts equal each other and texts of white
space; a null id comes after all others; of rows that also share id and length the one with the
last locator stays; an empty table gives no rows; columns other than id and text are not read, so
their names clash with nothing. Whole texts of any length are digested and compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written

_STATE = "spark.sql.streaming.stateStore."
STATE_STORE = {
    _STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STATE + "rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores do not each reserve disk ahead
    _STATE + "rocksdb.allowFAllocate": "false",
}
#: files of arrivals that one batch takes in
FILES_PER_BATCH = 10_000
#: white space that equality ignores
IGNORED = " \t\n\x0b\f\r"
ARRIVAL = "id LONG, digest STRING, n_chars LONG, file STRING, row LONG"


def normal(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(normal_text: Column) -> Column:
    return F.sha2(normal_text, 256)


def _rows(spark: SparkSession, table: str, key: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, digest, n_chars, file, row, normal) of a stored table."""
    at = F.col("_metadata")
    return (
        spark.read.parquet(table)
        .select(
            F.col(key).cast("long").alias("id"), normal(F.col(text)).alias("normal"),
            F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
            at["file_path"].alias("file"), at["row_index"].alias("row"),
        )
        .withColumn("digest", digest(F.col("normal")))
    )


def arrive(
    spark: SparkSession, table: str, folder: str, key: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> None:
    """Append the rows of a stored table to the arrivals of ``folder``."""
    rows = _rows(spark, table, key, text, digest)
    rows.select("id", "digest", "n_chars", "file", "row").write.mode("append").parquet(f"{folder}/arrivals")


def _held(rows: DataFrame) -> DataFrame:
    """What is retained of each digest."""
    stays = F.struct("n_chars", F.bitwise_not("id").alias("order"), "file", "row")
    return rows.groupBy("digest").agg(F.count("row").alias("n"), F.max(stays).alias("stays"))


def absorb(spark: SparkSession, folder: str, files_per_batch: int = FILES_PER_BATCH) -> None:
    """Let the stream take in what has arrived; each batch writes the digests it changed."""

    def changed(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        arrivals = (
            spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/arrivals")
        )
        (
            _held(arrivals).writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(changed)
            .start()
            .awaitTermination()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def held(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, stays): the state after the last batch. Both values only ever grow."""
    changes = spark.read.parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.max("stays").alias("stays"))


def resolve(
    spark: SparkSession, tables: list[str], folder: str, key: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row for each arrived row: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    ``tables`` are all tables that have arrived."""
    arrivals = spark.read.schema(ARRIVAL).parquet(f"{folder}/arrivals")
    state = written(held(spark, folder), "held")
    hits = state.where("n > 1").select("digest")
    whole = None
    for table in tables:
        rows = _rows(spark, table, key, text, digest)
        whole = rows if whole is None else whole.union(rows)
    # full bytes of the hits: the texts of a digest, each with its rows
    texts = whole.join(hits, "digest", "left_semi")
    same = written(texts.groupBy("digest", "normal").agg(F.count("row").alias("n")).groupBy("digest").agg(F.count("n").alias("texts")), "checked")
    torn = written(same.where("texts > 1").select("digest"), "torn")
    sure = _decided(arrivals, state, ["digest"])
    if torn.isEmpty():
        return sure
    apart = whole.join(torn, "digest", "left_semi")
    stays = F.max(F.struct("n_chars", F.bitwise_not("id").alias("order"), "file", "row"))
    classes = apart.groupBy("digest", "normal").agg(F.count("row").alias("n"), stays.alias("stays"))
    return sure.join(torn, "digest", "left_anti").select(*sure.columns).union(_decided(apart, classes, ["digest", "normal"]))


def _decided(rows: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    met = rows.join(classes, by)
    kept = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
    return met.select(
        "id", F.bitwise_not("stays.order").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest"
    )


def dedup(
    spark: SparkSession, table: str, key: str = "doc_id", text: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """The decisions on one stored table, in a folder of their own."""
    folder = shared_dir(spark, "exact_dedup")
    arrive(spark, table, folder, key, text, digest)
    absorb(spark, folder, files_per_batch)
    return resolve(spark, [table], folder, key, text, digest)
