"""Messages to notes and back. Orders always carry an explicit tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_track() -> WindowSpec:
    return Window.partitionBy("file_id", "track").orderBy("seq")


def by_pitch() -> WindowSpec:
    return Window.partitionBy("file_id", "track", "pitch").orderBy("seq")


def absolute_ticks(messages: DataFrame) -> DataFrame:
    return messages.withColumn("abs_tick", F.sum("delta").over(by_track().rowsBetween(Window.unboundedPreceding, 0)))


def is_on() -> Column:
    """A note_on of velocity 0 is a note_off."""
    return (F.col("kind") == "note_on") & (F.col("velocity") > 0)


def _played(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind").isin("note_on", "note_off")).withColumn("on", is_on())


def pair_last_on_wins(messages: DataFrame, channel_of: str = "on", velocity_of: str = "on") -> DataFrame:
    """An off closes the message before it if that is an on; struck again, a pitch forgets its first on; open notes are dropped.

    channel_of and velocity_of say whose they are: the on's, or those of what closes it ("off"), whose velocity is 64 for a note_off and
    0 for a note_on of velocity 0."""
    rows = _played(messages).select("*", F.lag("on").over(by_pitch()).alias("p_on"), F.lag("abs_tick").over(by_pitch()).alias("start_tick"), F.lag("velocity").over(by_pitch()).alias("p_velocity"), F.lag("channel").over(by_pitch()).alias("p_channel"))
    rows = rows.where(~F.col("on") & F.col("p_on"))
    channel = F.col("p_channel" if channel_of == "on" else "channel")
    velocity = F.col("p_velocity") if velocity_of == "on" else F.when(F.col("kind") == "note_off", 64).otherwise(0).cast("int")
    return rows.select("file_id", "track", channel.alias("channel"), "pitch", velocity.alias("velocity"), "start_tick", F.col("abs_tick").alias("end_tick"), (F.col("abs_tick") - F.col("start_tick")).alias("dur_ticks"), F.col("seq").alias("emit_seq"))


def pair_retrigger(messages: DataFrame) -> DataFrame:
    """Every on is a note, up to the next message of its pitch, or to the end of its track, then on channel 0."""
    end = F.max("abs_tick").over(Window.partitionBy("file_id", "track"))
    rows = _played(messages.withColumn("track_end", end)).select("*", F.lead("abs_tick").over(by_pitch()).alias("next_tick"), F.lead("channel").over(by_pitch()).alias("next_channel"), F.lead("on").over(by_pitch()).alias("next_on"))
    how = F.when(F.col("next_on"), "retrigger").when(~F.col("next_on"), "off").otherwise("flush")
    return rows.where("on").select("file_id", "track", F.coalesce("next_channel", F.lit(0)).alias("channel"), "pitch", "velocity", F.col("abs_tick").alias("start_tick"), F.coalesce("next_tick", "track_end").alias("end_tick"), F.col("seq").alias("emit_seq"), how.alias("closed_by"))


def first_tempo(messages: DataFrame, default: int = 500_000) -> DataFrame:
    first = F.min_by(F.when(F.col("kind") == "set_tempo", F.col("tempo")), F.when(F.col("kind") == "set_tempo", F.struct("track", "seq")))
    return messages.groupBy("file_id").agg(F.coalesce(first, F.lit(default)).alias("tempo"))


def last_seen_tempo(messages: DataFrame, default: int = 500_000) -> DataFrame:
    """The tempo last set in the same track."""
    return messages.withColumn("tempo", F.coalesce(F.last("tempo", ignorenulls=True).over(by_track().rowsBetween(Window.unboundedPreceding, 0)), F.lit(default)))


def mapped_seconds(messages: DataFrame, tpb: int = 220, default: int = 500_000) -> DataFrame:
    """Seconds by integrating the tempo map of the track."""
    before = F.coalesce(F.last("tempo", ignorenulls=True).over(by_track().rowsBetween(Window.unboundedPreceding, -1)), F.lit(default))
    rows = messages.withColumn("_part", F.col("delta") * before)
    return rows.withColumn("seconds", F.sum("_part").over(by_track().rowsBetween(Window.unboundedPreceding, 0)).cast("double") / F.lit(tpb * 1e6)).drop("_part")


def note_events(notes: DataFrame) -> DataFrame:
    """On and off events with delta ticks; at equal ticks ons come first."""
    both = F.array(F.struct(F.col("start_tick").alias("tick"), F.lit(0).alias("is_off"), F.col("velocity").alias("velocity")), F.struct(F.col("end_tick").alias("tick"), F.lit(1).alias("is_off"), F.lit(0).alias("velocity")))
    rows = notes.select("file_id", "track", "note_id", "pitch", F.explode(both).alias("e")).select("file_id", "track", "note_id", "pitch", "e.*")
    order = Window.partitionBy("file_id", "track").orderBy("tick", "is_off", "note_id")
    return rows.select("*", F.row_number().over(order).cast("long").alias("seq"), (F.col("tick") - F.lag("tick", 1, 0).over(order)).alias("delta"))


def roundtrip(notes: DataFrame) -> DataFrame:
    """Notes written as events and paired again, which is not the identity where notes of a pitch touch."""
    rows = note_events(notes).select("file_id", "track", "seq", F.col("tick").alias("abs_tick"), "pitch", "velocity", F.lit(0).alias("channel"), F.when(F.col("is_off") == 1, "note_off").otherwise("note_on").alias("kind"))
    return pair_last_on_wins(rows)


def kept_meta(messages: DataFrame, kinds: tuple[str, ...] = ("set_tempo", "time_signature", "key_signature", "track_name"), first_only: bool = False) -> DataFrame:
    """Meta messages moved to tick 0; first_only keeps the first of a track."""
    rows = messages.where(F.col("kind").isin(*kinds)).withColumn("abs_tick", F.lit(0).cast("long"))
    if first_only:
        rows = rows.withColumn("_nth", F.row_number().over(by_track())).where("_nth = 1").drop("_nth")
    return rows


def midi_profile(notes: DataFrame) -> DataFrame:
    return notes.groupBy("file_id").agg(F.count("*").alias("notes"), F.coalesce(F.min("pitch"), F.lit(0)).alias("lowest"), F.coalesce(F.max("pitch"), F.lit(0)).alias("highest"), F.countDistinct("track").alias("tracks"))


def onsets(notes: DataFrame) -> DataFrame:
    return notes.select("file_id", "start_tick").distinct()


def refined_events(events: DataFrame, tpb: int = 220, tempo: int = 500_000) -> DataFrame:
    """Events (file_id, track, t seconds, ord) in order of seconds; each delta is rounded to ticks by itself, so ticks drift."""
    order = Window.partitionBy("file_id", "track").orderBy("t", "ord")
    step = F.greatest(F.rint((F.col("t") - F.lag("t", 1, 0.0).over(order)) * F.lit(1e6) * tpb / tempo).cast("long"), F.lit(0))
    rows = events.withColumn("delta", step)
    return rows.withColumn("tick", F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merge_pedal(messages: DataFrame, pedal: DataFrame, inflate: bool = False) -> DataFrame:
    """Pedal events (file_id, track, abs_tick, value) merged into tracks. inflate: later messages shift by each inserted delta."""
    one = messages.select("file_id", "track", "abs_tick", F.lit(1).alias("source"), F.col("seq").cast("long").alias("ord"), "kind")
    two = pedal.select("file_id", "track", "abs_tick", F.lit(0).alias("source"), F.col("value").cast("long").alias("ord"), F.lit("control_change").alias("kind"))
    order = Window.partitionBy("file_id", "track").orderBy("abs_tick", "source", "ord")
    rows = one.unionByName(two).withColumn("delta", F.col("abs_tick") - F.lag("abs_tick", 1, 0).over(order))
    if inflate:
        group = F.sum("source").over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_group", F.coalesce(group, F.lit(0)))
        base = Window.partitionBy("file_id", "track", "_group")
        start = F.min(F.col("abs_tick") - F.col("delta")).over(base)
        rows = rows.withColumn("delta", F.col("abs_tick") - start).drop("_group")
    return rows.withColumn("tick", F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)))
