"""Operation logs, maps and requests that the test tables give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_key(user: str, number: str) -> Column:
    return F.concat(F.lpad(F.col(user).cast("string"), 8, "0"), F.lit("/"), F.lpad((F.col(number) % 100).cast("string"), 2, "0"))


def from_events(events: DataFrame) -> DataFrame:
    """k, v, seq, is_delete: an event is an upsert of its user's slot, an error its tombstone."""
    dead = F.col("event_type") == "error"
    return events.select(spread_key("user_id", "event_id").alias("k"), F.when(~dead, F.col("value")).alias("v"), F.col("event_id").alias("seq"), dead.alias("is_delete"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def last_seq(rows: DataFrame) -> int:
    """One aggregate that Parquet's footers answer."""
    return rows.agg(F.max("seq")).first()[0] or 0


def with_level(rows: DataFrame, last: int) -> DataFrame:
    """level 0 for the newest tenth of operations, 1 for the three tenths before, 2 for the rest."""
    return rows.withColumn("level", F.when(F.col("seq") * 10 >= 9 * last, 0).when(F.col("seq") * 10 >= 6 * last, 1).otherwise(2))


def levels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = ops(spark, sf_dir)
    marked = with_level(rows, last_seq(rows))
    return [marked.filter(F.col("level") == n).drop("level") for n in range(3)]


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, id: a map for each source of documents; src7 becomes 10, after the first ids that a catalogue gives."""
    return table(spark, sf_dir, "documents").select("source").distinct().select(F.col("source").alias("name"), (F.substring("source", 4, 9).cast("long") + 3).alias("id"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map, k, v: documents by source, the language as value."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("map"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("k"), F.col("lang").alias("v"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map, k, v: the labels as requests, spread over the maps and one that there isn't; some keys are another map's."""
    of = F.when(F.col("doc_id") % 11 == 0, F.lit("none")).otherwise(F.concat(F.lit("src"), ((F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)) % 20).cast("string")))
    return table(spark, sf_dir, "labels").select(of.alias("map"), F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("k"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v"))
