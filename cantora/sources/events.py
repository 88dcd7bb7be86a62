"""Event tables read as notes and messages, several recordings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each event: note_id, file_id, track, channel, pitch, velocity, start_tick, end_tick, dur_ticks, event_type."""
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("note_id"),
        (F.col("user_id") % 16).cast("int").alias("file_id"),
        (F.col("event_id") % 2).cast("int").alias("track"),
        (F.col("event_id") % 3).cast("int").alias("channel"),
        F.when(F.col("event_id") % 37 == 0, 19).otherwise(36 + (k % 5) * 7 + (F.col("user_id") % 4).cast("int") * 5).cast("int").alias("pitch"),
        F.least(F.lit(127), F.floor("value").cast("int") + 1).alias("velocity"),
        F.floor(us / 15_000_000).cast("long").alias("start_tick"),
        F.floor(F.col("value") * 4).cast("long").alias("dur_ticks"),
        "event_type",
        "value",
    )
    return rows.withColumn("end_tick", F.col("start_tick") + F.col("dur_ticks"))


def messages(rows: DataFrame) -> DataFrame:
    """On, off and tempo messages of notes: note_id, file_id, track, seq, abs_tick, delta, kind, pitch, velocity, channel, tempo."""
    both = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("note_on").alias("kind"), F.col("start_tick").alias("abs_tick")),
        F.struct(F.lit(2).alias("ord"), F.lit("note_off").alias("kind"), F.col("end_tick").alias("abs_tick")),
        F.struct(F.lit(0).alias("ord"), F.lit("set_tempo").alias("kind"), F.when(F.col("event_type") == "signup", F.col("start_tick")).alias("abs_tick")),
    )
    out = rows.select("note_id", "file_id", "track", "channel", "pitch", "velocity", F.explode(both).alias("m")).where("m.abs_tick is not null")
    tempo = F.when(F.col("m.kind") == "set_tempo", (400_000 + F.col("note_id") % 100 * 2_000).cast("int"))
    out = out.select("note_id", "file_id", "track", "channel", "pitch", "velocity", "m.*", tempo.alias("tempo"))
    order = Window.partitionBy("file_id", "track").orderBy("abs_tick", "ord", "note_id")
    return out.withColumn("seq", F.row_number().over(order).cast("long")).withColumn("delta", F.col("abs_tick") - F.lag("abs_tick", 1, 0).over(order)).drop("ord")
