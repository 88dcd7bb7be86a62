"""Beat slices, chords, progressions, voicings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantora.functions import music as M


def pitch_bit(pitch: Column) -> Column:
    return F.element_at(F.array(*(F.lit(1 << k) for k in range(12))), M.pitch_class(pitch) + 1)


def beat_slices(notes: DataFrame, beats: float = 1.0, tpb: int = M.TICKS_PER_BEAT) -> DataFrame:
    """file_id, t, notes (sorted distinct pitches), mask (pitch classes)."""
    return notes.groupBy("file_id", M.grid_floor(F.col("start_tick"), int(tpb * beats)).alias("t")).agg(F.sort_array(F.collect_set("pitch")).alias("notes"), F.bit_or(pitch_bit(F.col("pitch"))).alias("mask"))


def mask_names(masks: DataFrame, least: float = 0.6) -> DataFrame:
    """mask, name for distinct masks (4,096 at most): Jaccard score and half a point for the very set; ties to the lower root, then
    template order; below ``least`` the pitch classes in brackets."""
    dims = F.broadcast(M.chord_templates(masks.sparkSession).withColumnsRenamed({"mask": "template"}))  # 168 rows
    both = masks.select("mask").distinct().where(F.bit_count("mask") >= 2).crossJoin(dims)
    shared, union = F.bit_count(F.col("mask").bitwiseAND(F.col("template"))), F.bit_count(F.col("mask").bitwiseOR(F.col("template")))
    both = both.withColumn("score", shared / union + F.when(F.col("mask") == F.col("template"), 0.5).otherwise(0.0))
    best = both.groupBy("mask").agg(F.min(F.struct((-F.col("score")).alias("s"), "root", "q_ord", "name")).alias("b"))
    names = F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) > 0, n) for k, n in enumerate(M.NOTE_NAMES))), lambda x: x.isNotNull())
    return best.select("mask", F.when(-F.col("b.s") >= least, F.col("b.name")).otherwise(F.concat(F.lit("["), F.concat_ws("+", names), F.lit("]"))).alias("name"))


def identify_chords(notes: DataFrame, beats: float = 1.0, min_notes: int = 2) -> DataFrame:
    """file_id, t, name, notes, mask of slices with enough pitches and two pitch classes."""
    slices = beat_slices(notes, beats).where((F.size("notes") >= min_notes) & (F.bit_count("mask") >= 2))
    return slices.join(F.broadcast(mask_names(slices)), "mask").select("file_id", "t", "name", "notes", "mask")


def tonic(chords: DataFrame) -> DataFrame:
    """Most common root (first seen at ties) and minor or major by vote; dim and m7b5 count as minor."""
    rows = chords.withColumn("root", M.chord_root(F.col("name")))
    roots = rows.where("root is not null").groupBy("file_id", "root").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    top = roots.withColumn("_nth", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "first"))).where("_nth = 1")
    minor = F.count_if(F.col("name").contains("m") & ~F.col("name").contains("maj"))
    votes = rows.groupBy("file_id").agg(minor.alias("minor"), F.count("*").alias("chords"))
    return top.join(votes, "file_id").select("file_id", "root", F.when(F.col("minor") > F.col("chords") / 2, "minor").otherwise("major").alias("mode"), "minor", "chords")


def top_chords(chords: DataFrame, k: int = 3) -> DataFrame:
    rows = chords.groupBy("file_id", "name").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k).select("file_id", "rank", "name", "n")


def durations(chords: DataFrame, tpb: int = M.TICKS_PER_BEAT, block: bool = False) -> DataFrame:
    """Ticks to the next chord, four beats for the last; block chords last a beat at least."""
    dur = F.coalesce(F.lead("t").over(Window.partitionBy("file_id").orderBy("t")) - F.col("t"), F.lit(4 * tpb).cast("long"))
    return chords.withColumn("dur", F.greatest(dur, F.lit(tpb)) if block else dur)


def chart(chords: DataFrame) -> DataFrame:
    """file_id, measure, line of the non-empty measures."""
    rows = chords.groupBy("file_id", M.measure(F.col("t")).alias("measure")).agg(F.array_sort(F.collect_list(F.struct("t", "name"))).alias("c"))
    return rows.select("file_id", "measure", F.format_string("Measure %3d: | %s |", "measure", F.concat_ws(" | ", F.transform("c", lambda x: x["name"]))).alias("line"))


def chart_text(chords: DataFrame) -> DataFrame:
    """file_id, text of a whole chord chart."""
    rule = "=" * 60
    lines = chart(chords).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("measure", "line"))).alias("l"))
    total = chords.groupBy("file_id").count()
    body = F.concat_ws("\n", F.transform("l", lambda x: x["line"]))
    return lines.join(total, "file_id").select("file_id", F.concat_ws("\n", F.lit("CHORD CHART"), F.lit(rule), F.lit(""), body, F.lit(""), F.lit(rule), F.concat(F.lit("Total chords: "), F.col("count").cast("string"))).alias("text"))


def progression_summary(chords: DataFrame) -> DataFrame:
    """file_id, total, distinct, top: the three commonest names with their counts."""
    top = top_chords(chords).groupBy("file_id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda x: F.format_string("%s (%d)", x["name"], x["n"]))).alias("top"))
    return chords.groupBy("file_id").agg(F.count("*").alias("total"), F.countDistinct("name").alias("distinct")).join(top, "file_id")


def progression_text(chords: DataFrame) -> DataFrame:
    """file_id, text: chords by measure with their note names, then totals and the three commonest."""
    rule = "\u2500" * 60
    spelled = F.concat_ws(", ", F.transform("notes", lambda p: F.element_at(F.array(*(F.lit(n) for n in M.NOTE_NAMES)), (p % 12).cast("int") + 1)))
    lines = chords.select("file_id", "name", M.measure(F.col("t")).alias("measure"), F.struct("t", F.concat(F.lit("  "), F.rpad("name", F.greatest(F.length("name"), F.lit(12)), F.lit(" ")), F.lit(" ("), spelled, F.lit(")")).alias("line")).alias("x"))
    measures = lines.groupBy("file_id", "measure").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"])).alias("body"), F.count("*").alias("n"))
    body = measures.groupBy("file_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("measure", "body"))), lambda x: F.concat(F.lit("\nMeasure "), x["measure"].cast("string"), F.lit(":\n"), x["body"]))).alias("body"))
    top = top_chords(chords).groupBy("file_id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda x: F.format_string("%s(%dx)", x["name"], x["n"]))).alias("top"))
    total = chords.groupBy("file_id").agg(F.count("*").cast("string").alias("total"), F.countDistinct("name").cast("string").alias("unique"))
    text = F.concat_ws("\n", F.lit("Chord Progression Detected:"), F.lit(rule), "body", F.lit(rule), F.concat(F.lit("Total chords: "), "total"), F.concat(F.lit("Unique chords: "), "unique"), F.concat(F.lit("Most frequent: "), "top"))
    return body.join(total, "file_id").join(top, "file_id").select("file_id", text.alias("text"))


def normalised(notes: Column, octave: int = 4) -> Column:
    """Distinct pitch classes in one octave, moved by octaves into the piano's range."""
    base = 12 * (octave + 1)

    def place(pc: Column) -> Column:
        p = pc + base
        return F.when(p < M.LOW, p + 12 * F.ceil((M.LOW - p) / 12).cast("int")).when(p > M.HIGH, p - 12 * F.ceil((p - M.HIGH) / 12).cast("int")).otherwise(p)

    return F.transform(F.array_sort(F.array_distinct(F.transform(notes, lambda x: F.pmod(x, F.lit(12)).cast("int")))), place)


def voicing(chords: DataFrame, kind: str = "block", octave: int = 4, tpb: int = M.TICKS_PER_BEAT) -> DataFrame:
    """file_id, t, pitch, start_tick, end_tick of chords played as a block, an arpeggio or broken."""
    if kind not in ("block", "arpeggio", "broken"):
        raise ValueError(f"unknown voicing: {kind}")
    rows = durations(chords, tpb, kind == "block").select("file_id", "t", "dur", normalised(F.col("notes"), octave).alias("p"))
    rows = rows.select("file_id", "t", "dur", F.size("p").alias("n"), F.posexplode("p").alias("pos", "pitch"))
    if kind == "block":
        begin, end = F.col("t"), F.col("t") + F.col("dur")
    elif kind == "arpeggio":
        each = F.floor(F.col("dur") / F.col("n"))
        begin, end = F.col("t") + F.col("pos") * each, F.col("t") + (F.col("pos") + 1) * each
    else:  # half a beat each, a quarter apart
        begin = F.col("t") + F.col("pos") * (tpb // 2 + tpb // 4)
        end = begin + tpb // 2
    return rows.select("file_id", "t", "pitch", begin.cast("long").alias("start_tick"), end.cast("long").alias("end_tick"))
