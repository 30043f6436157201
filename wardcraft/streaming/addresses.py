"""Address points as a stream. The expressions keep no state, so they run on streams as they are; what fallbacks depend on is kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardcraft.operators.match import match_rows, prepare_addresses


def read_stream(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def prepared(stream: DataFrame) -> DataFrame:
    """A stream of addresses with street_norm, cover and number."""
    return prepare_addresses(stream)


def match_batches(specs: DataFrame, stream: DataFrame, folder: str, checkpoint: str):
    """Match each micro-batch to the rules; `matched` reads the result. Returns the query.

    A batch writes its matches and the names of its streets under its own number, over what an earlier try of it may have left.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = prepare_addresses(batch)
        rows.select("street_norm").distinct().write.mode("overwrite").parquet(f"{folder}/streets/batch={number}")
        found = match_rows(specs, rows, columns=("judet", "sv", "addr_id", "rule_no", "spec_no", "rule_norm", "street_norm"))
        found.write.mode("overwrite").parquet(f"{folder}/matches/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched(spark: SparkSession, folder: str) -> DataFrame:
    """What match_batches has found so far, as if all addresses had come at once: a name that some batch's street equals falls back in none."""
    found, streets = spark.read.parquet(f"{folder}/matches"), spark.read.parquet(f"{folder}/streets").select("street_norm").distinct()
    away = found.where("rule_norm <> street_norm").join(streets.withColumnRenamed("street_norm", "rule_norm"), "rule_norm", "left_anti")
    return found.where("rule_norm = street_norm").unionByName(away)
