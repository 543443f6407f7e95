"""Structured Streaming: landed games into the store, running position counts, windowed event rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources import pgn
from ..sources.store import Store


def landed_games(spark: SparkSession, path: str) -> DataFrame:
    """A stream of game texts from PGN files as they land."""
    lines = spark.readStream.option("lineSep", "\n[Event ").text(path)
    head = F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))
    return lines.where(F.trim("value") != "").select(head.alias("text"))


def load(texts: DataFrame, store: Store, subject: str, checkpoint: str) -> StreamingQuery:
    """Upserts each batch's games and moves; a batch run twice leaves the same rows."""

    def batch(rows: DataFrame, _: int) -> None:
        parsed = pgn.parse_nested(rows).persist()
        games, moves = pgn.split(parsed)
        games = pgn.for_subject(games, subject)
        store.put("games", games)
        store.put("moves", pgn.with_subject(moves, games))
        parsed.unpersist()

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def position_counts(moves: DataFrame) -> DataFrame:
    """How often each position was reached so far; to be written in update mode."""
    return moves.groupBy("pos_key").agg(F.count("*").alias("seen_count"))


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by window and type, repeats of an event within the watermark dropped."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
