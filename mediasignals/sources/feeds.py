"""Readers of landed feed files and of the feed catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

ITEM = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("title", "link", "summary", "description", "pubDate", "published")
    ]
)


#: bits of ``seq`` for the place of an item in its file
_PLACE_BITS = 23


def xml_entries(files: DataFrame, source_column: str | None = None) -> DataFrame:
    """Items of whole feed files (``value``) -> feed entries; the file name is the source by default.

    ``seq`` comes from the file's path and the item's place in it: items of a file keep their order,
    files follow each other in an order that depends on nothing but their paths. It is the same
    however the input is split, in a batch and in a stream.
    """
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    items = F.regexp_extract_all("value", F.lit(r"(?s)(<item[\s>].*?</item>)"), F.lit(1))
    listed = files.select(
        (F.col(source_column) if source_column else name).alias("source"),
        F.shiftrightunsigned(F.xxhash64(path), _PLACE_BITS + 1).alias("_file"),
        F.posexplode(items).alias("_place", "_item"),
    )
    parsed = listed.withColumn("i", F.from_xml("_item", ITEM.simpleString()))
    return parsed.select(
        "source",
        F.shiftleft(F.col("_file"), _PLACE_BITS).bitwiseOR(F.col("_place").cast("long")).alias("seq"),
        "i.title", "i.link", "i.summary", "i.description",
        F.coalesce("i.pubDate", "i.published").alias("published"),
    )


def read_xml_feeds(spark: SparkSession, path: str) -> DataFrame:
    return xml_entries(spark.read.text(path, wholetext=True))


def stream_xml_feeds(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return xml_entries(reader.text(path, wholetext=True))


def read_entries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Feed entries landed as JSON lines or Parquet."""
    return spark.read.schema(schemas.FEED_ENTRIES).format(fmt).load(path)


_CORRUPT = "_corrupt"


def _checked(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...]) -> DataFrame:
    """JSON lines in the columns of ``schema``, with the record itself in ``_corrupt`` where it does
    not fit the schema or lacks a required field."""
    read = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    rows = spark.read.schema(read).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).json(path)
    missing = reduce(lambda x, y: x | y, [F.coalesce(F.trim(c), F.lit("")) == "" for c in required])
    record = F.coalesce(_CORRUPT, F.when(missing, F.to_json(F.struct(*schema.fieldNames()))))
    return rows.withColumn(_CORRUPT, record)


def _good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def _rejects(rows: DataFrame) -> DataFrame:
    """The reject table: file and record."""
    return rows.filter(F.col(_CORRUPT).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col(_CORRUPT).alias("record")
    )


_FEED_FIELDS, _KEYWORD_FIELDS = ("name", "url"), ("kind", "term")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a catalogue; malformed records are left to ``catalogue_rejects``."""
    return _good(_checked(spark, path, schemas.FEEDS, _FEED_FIELDS))


def catalogue_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _rejects(_checked(spark, path, schemas.FEEDS, _FEED_FIELDS))


def feeds_matching(
    feeds: DataFrame, kind: str | None = None, region: str | None = None, tag: str | None = None
) -> DataFrame:
    if kind:
        feeds = feeds.filter(F.col("kind") == kind)
    if region:
        feeds = feeds.filter(F.col("region") == region)
    if tag:
        feeds = feeds.filter(F.array_contains("tags", tag))
    return feeds


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a dictionary; malformed records are left to ``keyword_rejects``."""
    return _good(_checked(spark, path, schemas.KEYWORDS, _KEYWORD_FIELDS))


def keyword_rejects(spark: SparkSession, path: str) -> DataFrame:
    return _rejects(_checked(spark, path, schemas.KEYWORDS, _KEYWORD_FIELDS))


def read_municipalities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MUNICIPALITIES).option("header", True).csv(path)
