"""A query for each operator over the event tables, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cantora.functions import music as M
from cantora.operators import cleaning, dynamics, hands, harmony, pairing, phrases, scoring, signal, temporal
from cantora.plans import flows
from cantora.sources import events, layout, smf, wav

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NOTES = """
notes as (
  select event_id as note_id, cast(user_id % 16 as int) as file_id, cast(event_id % 2 as int) as track, cast(event_id % 3 as int) as channel,
    cast(case when event_id % 37 = 0 then 19 else 36 + (cast(json_extract_string(props, '$.k') as int) % 5) * 7 + cast(user_id % 4 as int) * 5 end as int) as pitch,
    least(127, cast(floor(value) as int) + 1) as velocity, cast(floor((epoch_us(ts) - 1704067200000000) / 15000000) as bigint) as start_tick,
    cast(floor(value * 4) as bigint) as dur_ticks, cast(floor((epoch_us(ts) - 1704067200000000) / 15000000) as bigint) + cast(floor(value * 4) as bigint) as end_tick, event_type, value
  from events
)"""
_MESSAGES = """,
m0 as (
  select *, 1 as ord, 'note_on' as kind, start_tick as abs_tick, cast(null as int) as tempo from notes union all
  select *, 2, 'note_off', end_tick, null from notes union all
  select *, 0, 'set_tempo', start_tick, cast(400000 + note_id % 100 * 2000 as int) from notes where event_type = 'signup'
), messages as (
  select note_id, file_id, track, channel, pitch, velocity, kind, abs_tick, tempo, row_number() over w as seq, abs_tick - lag(abs_tick, 1, 0) over w as delta
  from m0 window w as (partition by file_id, track order by abs_tick, ord, note_id)
), played as (
  select *, kind = 'note_on' and velocity > 0 as is_on, max(abs_tick) over (partition by file_id, track) as track_end from messages
), played2 as (select * from played where kind in ('note_on', 'note_off'))"""
_KEPT = """,
reasons as (select *, case when velocity < 15 then 'quiet' when pitch not between 21 and 108 then 'range' when dur_ticks * (500000 / 1000 / 220) < 50 then 'short' else 'kept' end as reason from notes),
kept as (select * exclude (reason) from reasons where reason = 'kept')"""
_LEGATO = """,
l1 as (select *, start_tick - lag(end_tick) over (partition by file_id, pitch order by start_tick, note_id) as gap from kept),
l2 as (select *, sum(case when gap between 0 and 22 then 0 else 1 end) over (partition by file_id, pitch order by start_tick, note_id rows unbounded preceding) as island from l1),
merged as (
  select file_id, pitch, arg_min(note_id, (start_tick, note_id)) as note_id, min(start_tick) as start_tick, arg_max(end_tick, (start_tick, note_id)) as end_tick,
    cast(list_reduce(list(cast(velocity as double) order by start_tick, note_id), lambda x, y: trunc((x + y) / 2.0)) as int) as velocity, count(*) as merged
  from l2 group by file_id, pitch, island
)"""
_DIMS = f""",
names as (select unnest({M.NOTE_NAMES}) as n, unnest(range(12)) as root),
quals as (select unnest({[s for _, s, _ in M.QUALITIES]}) as symbol, unnest({[i for _, _, i in M.QUALITIES]}) as steps, unnest(range(14)) as q_ord),
dims as (select root, q_ord, n || symbol as name, list_sum(list_distinct(list_transform(steps, lambda i: 1 << ((root + i) % 12))))::int as template from names, quals)"""
_CHORDS = (
    _DIMS
    + """,
slices as (select file_id, (start_tick // 220) * 220 as t, list_sort(list_distinct(list(pitch))) as notes, bit_or(1 << (pitch % 12))::int as mask from notes group by 1, 2),
s2 as (select * from slices where len(notes) >= 2 and bit_count(mask) >= 2),
scored as (select mask, root, q_ord, name, bit_count(mask & template) / bit_count(mask | template) + case when mask = template then 0.5 else 0 end as score from (select distinct mask from s2), dims),
best as (select mask, arg_min(name, (-score, root, q_ord)) as name, max(score) as score from scored group by mask),
called as (select mask, case when score >= 0.6 then name else '[' || (select string_agg(n, '+' order by root) from names where (mask >> root) & 1 = 1) || ']' end as name from best),
chords as (select file_id, t, name, notes, mask from s2 join called using (mask))"""
)


def query(name: str, sql: str | None = None, base: str = ""):
    """Registers a query; its SQL stands on the notes and what ``base`` adds."""

    def register(f):
        QUERIES[name] = f
        if sql:
            recursive = "recursive " if "recursive:" in sql else ""
            SQL[name] = f"with {recursive}{_NOTES}{base}{sql.replace('recursive:', '')}"
        return f

    return register


notes_of = events.notes


def messages_of(spark: SparkSession, d: str) -> DataFrame:
    return events.messages(events.notes(spark, d))


def kept_of(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.kept_notes(notes_of(spark, d))


def seconds_of(notes: DataFrame) -> DataFrame:
    per = F.lit(M.ms_per_tick() / 1000)
    return notes.withColumn("start_s", F.col("start_tick") * per).withColumn("end_s", F.col("end_tick") * per)


# Sources and pairing


@query("notes_projection", " select note_id, file_id, track, channel, pitch, velocity, start_tick, end_tick, dur_ticks from notes")
def _(spark, d):
    return notes_of(spark, d).drop("event_type", "value")


@query("delta_to_abs", " select file_id, track, seq, delta, abs_tick from messages", _MESSAGES)
def _(spark, d):
    return pairing.absolute_ticks(messages_of(spark, d).drop("abs_tick")).select("file_id", "track", "seq", "delta", "abs_tick")


@query(
    "pair_last_on_wins",
    """, p as (select *, lag(is_on) over w as p_on, lag(abs_tick) over w as start_tick, lag(velocity) over w as p_velocity, lag(channel) over w as p_channel from played2 window w as (partition by file_id, track, pitch order by seq))
    select file_id, track, p_channel as channel, pitch, p_velocity as velocity, start_tick, abs_tick as end_tick, abs_tick - start_tick as dur_ticks, seq as emit_seq from p where not is_on and p_on""",
    _MESSAGES,
)
def _(spark, d):
    return pairing.pair_last_on_wins(messages_of(spark, d))


@query(
    "pair_as_closed",
    """, p as (select *, lag(is_on) over w as p_on, lag(abs_tick) over w as start_tick from played2 window w as (partition by file_id, track, pitch order by seq))
    select file_id, track, channel, pitch, case when kind = 'note_off' then 64 else 0 end as velocity, start_tick, abs_tick as end_tick, seq as emit_seq from p where not is_on and p_on""",
    _MESSAGES,
)
def _(spark, d):
    return pairing.pair_last_on_wins(messages_of(spark, d), "off", "off").drop("dur_ticks")


@query(
    "pair_retrigger",
    """, p as (select *, lead(is_on) over w as n_on, lead(abs_tick) over w as n_tick, lead(channel) over w as n_channel from played2 window w as (partition by file_id, track, pitch order by seq))
    select file_id, track, coalesce(n_channel, 0) as channel, pitch, velocity, abs_tick as start_tick, coalesce(n_tick, track_end) as end_tick, seq as emit_seq,
      case when n_on then 'retrigger' when not n_on then 'off' else 'flush' end as closed_by from p where is_on""",
    _MESSAGES,
)
def _(spark, d):
    return pairing.pair_retrigger(messages_of(spark, d))


@query("first_tempo", " select file_id, coalesce(arg_min(tempo, (track, seq)) filter (kind = 'set_tempo'), 500000) as tempo from messages group by file_id", _MESSAGES)
def _(spark, d):
    return pairing.first_tempo(messages_of(spark, d))


_LAST = ", lt as (select *, coalesce(last_value(tempo ignore nulls) over (partition by file_id, track order by seq rows unbounded preceding), 500000) as seen from messages)"


@query("tempo_last_seen", " select file_id, track, seq, seen as tempo from lt", _MESSAGES + _LAST)
def _(spark, d):
    return pairing.last_seen_tempo(messages_of(spark, d)).select("file_id", "track", "seq", "tempo")


@query("tick_to_second", " select file_id, track, seq, pitch, abs_tick as tick, cast(abs_tick * seen as double) / 220000000.0 as start_s from lt where kind = 'note_on'", _MESSAGES + _LAST)
def _(spark, d):
    rows = pairing.last_seen_tempo(messages_of(spark, d)).where(pairing.is_on())
    return rows.select("file_id", "track", "seq", "pitch", F.col("abs_tick").alias("tick"), M.tick_to_second(F.col("abs_tick"), F.col("tempo")).alias("start_s"))


@query(
    "tempo_map_seconds",
    """, b as (select *, delta * coalesce(last_value(tempo ignore nulls) over (partition by file_id, track order by seq rows between unbounded preceding and 1 preceding), 500000) as part from messages)
    select file_id, track, seq, cast(sum(part) over (partition by file_id, track order by seq rows unbounded preceding) as double) / 220000000.0 as seconds from b""",
    _MESSAGES,
)
def _(spark, d):
    return pairing.mapped_seconds(messages_of(spark, d)).select("file_id", "track", "seq", "seconds")


@query("onset_times", " select distinct file_id, start_tick from notes")
def _(spark, d):
    return pairing.onsets(notes_of(spark, d))


@query("onset_rows", " select file_id, abs_tick as tick, pitch, velocity, channel, cast(abs_tick * seen as double) / 220000000.0 as t from lt where kind = 'note_on'", _MESSAGES + _LAST)
def _(spark, d):
    rows = pairing.last_seen_tempo(messages_of(spark, d)).where(pairing.is_on())
    return rows.select("file_id", F.col("abs_tick").alias("tick"), "pitch", "velocity", "channel", M.tick_to_second(F.col("abs_tick"), F.col("tempo")).alias("t"))


@query("midi_profile", " select file_id, count(*) as notes, min(pitch) as lowest, max(pitch) as highest, count(distinct track) as tracks from notes group by file_id")
def _(spark, d):
    return pairing.midi_profile(notes_of(spark, d))


_EVENTS = """, e0 as (select file_id, track, note_id, pitch, start_tick as tick, 0 as is_off, velocity from notes union all select file_id, track, note_id, pitch, end_tick, 1, 0 from notes),
ev as (select *, row_number() over w as seq, tick - lag(tick, 1, 0) over w as delta from e0 window w as (partition by file_id, track order by tick, is_off, note_id))"""


@query("note_events_delta", " select file_id, track, note_id, pitch, tick, is_off, velocity, seq, delta from ev", _EVENTS)
def _(spark, d):
    return pairing.note_events(notes_of(spark, d))


@query(
    "roundtrip_notes",
    """, p as (select *, lag(is_off) over w as p_off, lag(tick) over w as start_tick, lag(velocity) over w as p_velocity from ev window w as (partition by file_id, track, pitch order by seq))
    select file_id, track, pitch, p_velocity as velocity, start_tick, tick as end_tick from p where is_off = 1 and p_off = 0""",
    _EVENTS,
)
def _(spark, d):
    return pairing.roundtrip(notes_of(spark, d)).select("file_id", "track", "pitch", "velocity", "start_tick", "end_tick")


@query("meta_first_of_track", " select file_id, track, cast(0 as bigint) as abs_tick, arg_min(tempo, seq) as tempo from messages where kind = 'set_tempo' group by file_id, track", _MESSAGES)
def _(spark, d):
    return pairing.kept_meta(messages_of(spark, d), first_only=True).select("file_id", "track", "abs_tick", "tempo")


@query("meta_kept", " select file_id, track, seq, cast(0 as bigint) as abs_tick, tempo from messages where kind = 'set_tempo'", _MESSAGES)
def _(spark, d):
    return pairing.kept_meta(messages_of(spark, d)).select("file_id", "track", "seq", "abs_tick", "tempo")


@query(
    "refined_events",
    """, s as (select file_id, track, note_id * 2 + is_off as ord, tick * (500000 / 1000 / 220 / 1000) * 1.01 as t from ev),
    g as (select *, greatest(cast(round_even((t - lag(t, 1, 0.0) over w) * 1e6 * 220 / 500000, 0) as bigint), 0) as delta from s window w as (partition by file_id, track order by t, ord))
    select file_id, track, ord, delta, cast(sum(delta) over (partition by file_id, track order by t, ord rows unbounded preceding) as bigint) as tick from g""",
    _EVENTS,
)
def _(spark, d):
    rows = pairing.note_events(notes_of(spark, d)).select("file_id", "track", (F.col("note_id") * 2 + F.col("is_off")).alias("ord"), (F.col("tick") * F.lit(M.ms_per_tick() / 1000) * F.lit(1.01)).alias("t"))
    return pairing.refined_events(rows).select("file_id", "track", "ord", "delta", "tick")


_PEDAL_IN = """, pd as (select file_id, 0 as track, (start_tick // 880) * 880 as abs_tick, 127 as value from notes where event_type = 'purchase' group by all),
pm as (select file_id, track, abs_tick, 1 as source, seq as ord, kind from messages union all select file_id, track, abs_tick, 0, value, 'control_change' from pd)"""


def _pedal_in(notes: DataFrame) -> DataFrame:
    return notes.where("event_type = 'purchase'").select("file_id", F.lit(0).alias("track"), M.grid_floor(F.col("start_tick"), 880).alias("abs_tick"), F.lit(127).alias("value")).distinct()


@query("pedal_merge", " select file_id, track, abs_tick as tick, kind, ord, abs_tick - lag(abs_tick, 1, 0) over (partition by file_id, track order by abs_tick, source, ord) as delta from pm", _MESSAGES + _PEDAL_IN)
def _(spark, d):
    notes = notes_of(spark, d)
    return pairing.merge_pedal(events.messages(notes), _pedal_in(notes)).select("file_id", "track", "tick", "kind", "ord", "delta")


@query(
    "pedal_merge_inflated",
    """, g as (select *, abs_tick - lag(abs_tick, 1, 0) over w as d0, coalesce(sum(source) over (partition by file_id, track order by abs_tick, source, ord rows between unbounded preceding and 1 preceding), 0) as grp from pm window w as (partition by file_id, track order by abs_tick, source, ord)),
    h as (select *, abs_tick - min(abs_tick - d0) over (partition by file_id, track, grp) as delta from g)
    select file_id, track, kind, ord, delta, cast(sum(delta) over (partition by file_id, track order by abs_tick, source, ord rows unbounded preceding) as bigint) as tick from h""",
    _MESSAGES + _PEDAL_IN,
)
def _(spark, d):
    notes = notes_of(spark, d)
    return pairing.merge_pedal(events.messages(notes), _pedal_in(notes), inflate=True).select("file_id", "track", "kind", "ord", "delta", "tick")


# Correction


@query("correct_filter", " select note_id, reason from reasons", _KEPT)
def _(spark, d):
    return cleaning.with_reason(notes_of(spark, d)).select("note_id", "reason")


@query("short_filter_constant", " select note_id from notes where dur_ticks * 2.3 >= 50")
def _(spark, d):
    return cleaning.drop_short(notes_of(spark, d)).select("note_id")


_EXTENDED = ", ex as (select *, greatest(cast(dur_ticks as double), 120 / (500000 / 1000 / 220)) as dur from kept)"


@query("correct_extend", " select note_id, dur, start_tick + dur as \"end\" from ex", _KEPT + _EXTENDED)
def _(spark, d):
    return cleaning.extend(kept_of(spark, d)).select("note_id", "dur", "end")


@query(
    "quantize_half",
    ", q as (select *, start_tick + 0.5::double * (round_even(start_tick / 55.0::double, 0) * 55.0::double - start_tick) as s from ex) select note_id, cast(trunc(s) as bigint) as start_tick, cast(trunc(trunc(s) + dur) as bigint) as end_tick from q",
    _KEPT + _EXTENDED,
)
def _(spark, d):
    return cleaning.quantise(cleaning.extend(kept_of(spark, d))).select("note_id", "start_tick", "end_tick")


@query("legato_merge", " select file_id, pitch, note_id, start_tick, end_tick, merged from merged", _KEPT + _LEGATO)
def _(spark, d):
    return cleaning.merge_legato(kept_of(spark, d)).select("file_id", "pitch", "note_id", "start_tick", "end_tick", F.col("merged").cast("long").alias("merged"))


@query("legato_velocity_fold", " select note_id, velocity from merged", _KEPT + _LEGATO)
def _(spark, d):
    return cleaning.merge_legato(kept_of(spark, d)).select("note_id", "velocity")


@query(
    "rapid_pair_merge",
    """, r0 as (select *, start_tick - lag(end_tick) over w as gap from notes where dur_ticks * 2.3 >= 50 window w as (partition by file_id, track, pitch order by start_tick, note_id)),
    r1 as (select *, sum(case when gap * 2.3 < 30 then 0 else 1 end) over (partition by file_id, track, pitch order by start_tick, note_id rows unbounded preceding) as island from r0),
    r2 as (select *, (row_number() over (partition by file_id, track, pitch, island order by start_tick, note_id) - 1) // 2 as pair from r1)
    select file_id, track, pitch, min(start_tick) as start_tick, arg_max(end_tick, (start_tick, note_id)) as end_tick, arg_min(velocity, (start_tick, note_id)) as velocity, arg_min(channel, (start_tick, note_id)) as channel, count(*) as joined
    from r2 group by file_id, track, pitch, island, pair""",
)
def _(spark, d):
    return cleaning.merge_rapid(cleaning.drop_short(notes_of(spark, d)))


@query(
    "correct_stats",
    """, c as (select file_id, count(*) as total, count(*) filter (reason = 'quiet') as removed_quiet, count(*) filter (reason = 'range') as removed_range, count(*) filter (reason = 'short') as removed_short,
      count(*) filter (reason = 'kept' and dur_ticks * (500000 / 1000 / 220) < 120) as extended from reasons group by file_id),
    g as (select file_id, cast(sum(merged - 1) as bigint) as merged from merged group by file_id)
    select c.*, coalesce(g.merged, 0) as merged from c left join g using (file_id)""",
    _KEPT + _LEGATO,
)
def _(spark, d):
    return cleaning.correction_stats(notes_of(spark, d))


@query("correction_report", """, c as (select file_id, count(*) as total, count(*) filter (reason <> 'kept') as removed from reasons group by file_id)
    select file_id, printf('file %d: %d notes, %d removed, %d remain', file_id, total, removed, total - removed) as line from c""", _KEPT)
def _(spark, d):
    rows = cleaning.correction_stats(notes_of(spark, d)).withColumn("removed", F.col("removed_quiet") + F.col("removed_range") + F.col("removed_short"))
    return rows.select("file_id", F.format_string("file %d: %d notes, %d removed, %d remain", "file_id", "total", "removed", F.col("total") - F.col("removed")).alias("line"))


_HIST = ", pcs as (select unnest(range(12)) as pc), hist as (select file_id, pc, (select count(*) from notes n where n.file_id = f.file_id and n.pitch % 12 = pc) / f.total as share from (select file_id, count(*) as total from notes group by file_id) f, pcs)"


@query("pitch_class_hist", " select file_id, cast(pc as int) as pc, round(share, 9) as share from hist", _HIST)
def _(spark, d):
    return cleaning.pitch_class_histogram(notes_of(spark, d)).select("file_id", F.posexplode("hist").alias("pc", "share")).withColumn("share", F.round("share", 9))


def _keys(sign: str) -> str:
    return f""", prof as (select 0 as m_ord, 'major' as mode, unnest({M.PROFILES['major']}) as v, unnest(range(12)) as i union all select 1, 'minor', unnest({M.PROFILES['minor']}), unnest(range(12))),
    keyed as (select file_id, root, mode, m_ord, round(coalesce(corr(share, v), 0), 9) as r from hist, (select unnest(range(12)) as root) k, prof where prof.i = (pc {sign} root + 12) % 12 group by all having true),
    keys as (select file_id, arg_min(root, (-r, root, m_ord))::int as root, arg_min(mode, (-r, root, m_ord)) as mode, round(max(r), 6) as r from keyed group by file_id)"""


@query("key_detect_compat", " select file_id, root, mode, r from keys", _HIST + _keys("+"))
def _(spark, d):
    return cleaning.detect_key(notes_of(spark, d)).drop("scale_mask")


@query("key_detect_fixed", " select file_id, root, mode, r from keys", _HIST + _keys("-"))
def _(spark, d):
    return cleaning.detect_key(notes_of(spark, d), fixed=True).drop("scale_mask")


@query(
    "out_of_key",
    " select n.file_id, count(*) filter (not list_contains(case when mode = 'major' then [0, 2, 4, 5, 7, 9, 11] else [0, 2, 3, 5, 7, 8, 10] end, (pitch - root + 120) % 12)) as flagged, count(*) as total from notes n join keys using (file_id) group by n.file_id",
    _HIST + _keys("+"),
)
def _(spark, d):
    notes = notes_of(spark, d)
    return cleaning.flag_out_of_key(notes, cleaning.detect_key(notes)).groupBy("file_id").agg(F.count_if("out_of_key").alias("flagged"), F.count("*").alias("total"))


@query("corrected_notes", """, q as (select *, start_tick + 0.5::double * (round_even(start_tick / 55.0::double, 0) * 55.0::double - start_tick) as s from ex),
    k as (select file_id, pitch, note_id, velocity, cast(trunc(s) as bigint) as start_tick, cast(trunc(trunc(s) + dur) as bigint) as end_tick from q),
    l1 as (select *, start_tick - lag(end_tick) over (partition by file_id, pitch order by start_tick, note_id) as gap from k),
    l2 as (select *, sum(case when gap between 0 and 22 then 0 else 1 end) over (partition by file_id, pitch order by start_tick, note_id rows unbounded preceding) as island from l1)
    select file_id, pitch, min(start_tick) as start_tick, arg_max(end_tick, (start_tick, note_id)) as end_tick, cast(list_reduce(list(cast(velocity as double) order by start_tick, note_id), lambda x, y: trunc((x + y) / 2.0)) as int) as velocity
    from l2 group by file_id, pitch, island""", _KEPT + _EXTENDED)
def _(spark, d):
    return cleaning.correct(notes_of(spark, d)).select("file_id", "pitch", "start_tick", "end_tick", "velocity")


# Harmony


@query("beat_slices", " select file_id, t, array_to_string(notes, ' ') as notes, mask from slices", _CHORDS)
def _(spark, d):
    return harmony.beat_slices(notes_of(spark, d)).select("file_id", "t", F.array_join("notes", " ").alias("notes"), "mask")


@query("chord_identify", " select file_id, t, name, mask from chords", _CHORDS)
def chord_identify(spark, d):
    return harmony.identify_chords(notes_of(spark, d)).select("file_id", "t", "name", "mask")


@query("chord_counts", " select file_id, name, count(*) as n from chords group by all", _CHORDS)
def chord_counts(spark, d):
    return harmony.identify_chords(notes_of(spark, d)).groupBy("file_id", "name").agg(F.count("*").alias("n"))


@query(
    "chord_all_masks",
    ", ms as (select unnest(range(1, 4096))::int as mask), sc as (select mask, root, q_ord, name, bit_count(mask & template) / bit_count(mask | template) + case when mask = template then 0.5 else 0 end as score from ms, dims where bit_count(mask) >= 2), b as (select mask, arg_min(name, (-score, root, q_ord)) as name, max(score) as score from sc group by mask) select mask, case when score >= 0.6 then name else '[' || (select string_agg(n, '+' order by root) from names where (mask >> root) & 1 = 1) || ']' end as name from b",
    _DIMS,
)
def _(spark, d):
    return harmony.mask_names(spark.range(1, 4096).selectExpr("cast(id as int) as mask"))


_ROOTED = ", rooted as (select *, case when contains(name, '#') then name[1:2] else name[1:1] end as root from chords)"


@query(
    "chord_tonic",
    f""", rr as (select file_id, root, count(*) as n, min(t) as first from rooted where root in ({", ".join(f"'{n}'" for n in M.NOTE_NAMES)}) group by all),
    top as (select file_id, arg_min(root, (-n, first)) as root from rr group by file_id),
    v as (select file_id, count(*) filter (contains(name, 'm') and not contains(name, 'maj')) as minor, count(*) as chords from chords group by file_id)
    select file_id, root, case when minor > chords - minor then 'minor' else 'major' end as mode, minor, chords from top join v using (file_id)""",
    _CHORDS + _ROOTED,
)
def _(spark, d):
    return harmony.tonic(harmony.identify_chords(notes_of(spark, d)))


_TOP3 = ", cc as (select file_id, name, count(*) as n, min(t) as first from chords group by all), t3 as (select file_id, cast(row_number() over (partition by file_id order by n desc, first) as int) as rank, name, n from cc)"


@query("chord_top3", " select * from t3 where rank <= 3", _CHORDS + _TOP3)
def _(spark, d):
    return harmony.top_chords(harmony.identify_chords(notes_of(spark, d)))


@query("progression_summary", " select c.file_id, count(*) as total, count(distinct c.name) as \"distinct\", any_value(x.top) as top from chords c join (select file_id, string_agg(name || ' (' || n || ')', ', ' order by rank) as top from t3 where rank <= 3 group by file_id) x using (file_id) group by c.file_id", _CHORDS + _TOP3)
def _(spark, d):
    return harmony.progression_summary(harmony.identify_chords(notes_of(spark, d)))


@query(
    "progression_text",
    """, nm as (select unnest({names}) as n, unnest(range(12)) as pc), sp as (select file_id, t, name, string_agg(nm.n, ', ' order by u.p) as spelled from (select file_id, t, name, unnest(notes) as p from chords) u join nm on nm.pc = u.p % 12 group by file_id, t, name),
    ms as (select file_id, t // 880 + 1 as m, string_agg('  ' || name || repeat(' ', greatest(0, 12 - len(name))) || ' (' || spelled || ')', chr(10) order by t) as body from sp group by 1, 2),
    bd as (select file_id, string_agg(chr(10) || 'Measure ' || cast(m as bigint) || ':' || chr(10) || body, chr(10) order by m) as body from ms group by file_id),
    tot as (select file_id, count(*) as total, count(distinct name) as uniq from chords group by file_id),
    tops as (select file_id, string_agg(name || '(' || n || 'x)', ', ' order by rank) as top from t3 where rank <= 3 group by file_id)
    select file_id, 'Chord Progression Detected:' || chr(10) || repeat(chr(9472), 60) || chr(10) || body || chr(10) || repeat(chr(9472), 60) || chr(10) || 'Total chords: ' || total || chr(10) || 'Unique chords: ' || uniq || chr(10) || 'Most frequent: ' || top as text
    from bd join tot using (file_id) join tops using (file_id)""".replace("{names}", str(M.NOTE_NAMES)),
    _CHORDS + _TOP3,
)
def _(spark, d):
    return harmony.progression_text(harmony.identify_chords(notes_of(spark, d)))


_DURS = ", durs as (select *, coalesce(lead(t) over (partition by file_id order by t) - t, 880) as dur from chords), normal as (select *, list_sort(list_distinct(list_transform(notes, lambda x: x % 12 + 60))) as p from durs), voiced as (select *, unnest(p) as pitch, unnest(range(len(p))) as pos from normal)"


@query("chord_durations", " select file_id, t, name, dur from durs", _CHORDS + _DURS)
def _(spark, d):
    return harmony.durations(harmony.identify_chords(notes_of(spark, d))).select("file_id", "t", "name", "dur")


@query("chord_chart", " select file_id, cast(t // 880 + 1 as int) as measure, printf('Measure %3d: | %s |', cast(t // 880 + 1 as int), string_agg(name, ' | ' order by t)) as line from chords group by file_id, t // 880", _CHORDS)
def _(spark, d):
    return harmony.chart(harmony.identify_chords(notes_of(spark, d)))


@query("chart_text", ", ln as (select file_id, t // 880 as m, printf('Measure %3d: | %s |', cast(t // 880 + 1 as int), string_agg(name, ' | ' order by t)) as line, count(*) as n from chords group by file_id, t // 880) select file_id, 'CHORD CHART' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || x.body || chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'Total chords: ' || x.total as text from (select file_id, string_agg(line, chr(10) order by m) as body, cast(cast(sum(n) as bigint) as varchar) as total from ln group by file_id) x", _CHORDS)
def _(spark, d):
    return harmony.chart_text(harmony.identify_chords(notes_of(spark, d)))


@query("voicing_block", " select file_id, t, pitch, t as start_tick, t + greatest(dur, 220) as end_tick from voiced", _CHORDS + _DURS)
def _(spark, d):
    return harmony.voicing(harmony.identify_chords(notes_of(spark, d)), "block")


@query("voicing_arpeggio", " select file_id, t, pitch, t + pos * (dur // len(p)) as start_tick, t + (pos + 1) * (dur // len(p)) as end_tick from voiced", _CHORDS + _DURS)
def _(spark, d):
    return harmony.voicing(harmony.identify_chords(notes_of(spark, d)), "arpeggio")


@query("voicing_broken", " select file_id, t, pitch, t + pos * 165 as start_tick, t + pos * 165 + 110 as end_tick from voiced", _CHORDS + _DURS)
def _(spark, d):
    return harmony.voicing(harmony.identify_chords(notes_of(spark, d)), "broken")


# Joins, polyphony, pedal


_GRID = ", grid as (select file_id, i, (max_end * i / 99.0::double) as t from (select file_id, max(end_tick) as max_end from notes group by file_id), (select unnest(range(100))::int as i)), poly as (select g.file_id, g.i, g.t, count(n.note_id) as n from grid g left join notes n on n.file_id = g.file_id and g.t between n.start_tick and n.end_tick group by all)"


@query("polyphony_grid", " select file_id, i, round(t, 6) as t, n from poly", _GRID)
def _(spark, d):
    return scoring.polyphony(notes_of(spark, d)).select("file_id", "i", F.round("t", 6).alias("t"), "n")


@query("polyphony_bucket", ", a as (select file_id, avg(n) as mean from poly group by file_id) select file_id, mean, cast(case when mean between 2 and 6 then 0.9 when mean between 1 and 8 then 0.7 else 0.5 end as double) as score from a", _GRID)
def _(spark, d):
    return scoring.polyphony_score(scoring.polyphony(notes_of(spark, d)))


_PEDAL = """, sec as (select file_id, start_tick * (500000 / 1000 / 220 / 1000) as s, (start_tick + dur_ticks * 10) * (500000 / 1000 / 220 / 1000) as e from notes),
ends as (select file_id, max(e) as e, cast(trunc(max(e) * 20) as int) as n from sec group by file_id),
grid as (select file_id, e, e * i / (n - 1) as t from (select *, unnest(range(n)) as i from ends)),
pts as (select file_id, t as x, 1 as kind, 0 as step from grid union all select file_id, s, 0, 1 from sec union all select file_id, e, 2, -1 from sec),
cnt as (select *, sum(step) over (partition by file_id order by x, kind rows unbounded preceding) as n from pts),
st as (select file_id, x as t, n >= 4 as down from cnt where kind = 1),
ed as (select file_id, t, down from (select *, lag(down, 1, false) over (partition by file_id order by t) as was from st) where down <> was),
fin as (select file_id, t, down from ed union all select x.file_id, ends.e, false from (select file_id, arg_max(down, t) as down from ed group by file_id) x join ends using (file_id) where x.down)"""


def _long_seconds(notes: DataFrame) -> DataFrame:
    per = F.lit(M.ms_per_tick() / 1000)
    return notes.select("file_id", (F.col("start_tick") * per).alias("start_s"), ((F.col("start_tick") + F.col("dur_ticks") * 10) * per).alias("end_s"))


@query("pedal_edges", " select file_id, round(t, 6) as t, down from fin", _PEDAL)
def _(spark, d):
    return dynamics.detect_pedal(_long_seconds(notes_of(spark, d)), short=False).withColumn("t", F.round("t", 6))


@query(
    "pedal_filter_short",
    """, k as (select *, lead(t) over w as nx, lag(t) over w as pv, lag(down) over w as was, count(*) over (partition by file_id) as c from fin window w as (partition by file_id order by t))
    select file_id, round(t, 6) as t, down from k where c < 2 or not (coalesce(down and nx - t < 0.5, false) or coalesce(not down and was and t - pv < 0.5, false))""",
    _PEDAL,
)
def _(spark, d):
    return dynamics.detect_pedal(_long_seconds(notes_of(spark, d))).withColumn("t", F.round("t", 6))


_ONSETS = ", au as (select distinct file_id, start_tick as t from notes where track = 1), mi as (select note_id, file_id, start_tick as t from notes where track = 0), nr as (select mi.note_id, mi.file_id, mi.t, arg_min(au.t, (abs(au.t - mi.t), au.t)) as near from mi join au using (file_id) group by all)"


def _heard(notes: DataFrame) -> DataFrame:
    return notes.where("track = 1").select("file_id", F.col("start_tick").alias("t")).distinct()


def _written(notes: DataFrame) -> DataFrame:
    return notes.where("track = 0").select("note_id", "file_id", F.col("start_tick").alias("t"))


@query("nearest_onset_snap", " select note_id, file_id, t, case when abs(near - t) <= 22 then near end as nearest from nr", _ONSETS)
def _(spark, d):
    notes = notes_of(spark, d)
    return temporal.nearest(_written(notes), _heard(notes), tolerance=22)


@query("timing_corrections", " select file_id, count(near) as snapped, round(avg(abs(near - t) * (500000 / 1000 / 220)), 6) as mean_ms from nr where abs(near - t) <= 22 group by file_id", _ONSETS)
def _(spark, d):
    notes = notes_of(spark, d)
    near = temporal.nearest(_written(notes), _heard(notes), tolerance=22).where("nearest is not null")
    return near.groupBy("file_id").agg(F.count("*").alias("snapped"), F.round(F.avg(F.abs(F.col("nearest") - F.col("t")) * F.lit(M.ms_per_tick())), 6).alias("mean_ms"))


_PRF = ", hs as (select file_id, count(distinct near) filter (abs(near - t) <= 22) as hits, count(*) as written from nr group by file_id), th as (select file_id, count(*) as heard from au group by file_id), prf as (select file_id, hits, written, heard, hits / written as \"precision\", hits / heard as recall, coalesce(2 * (hits / written) * (hits / heard) / nullif(hits / written + hits / heard, 0), 0) as f1 from hs join th using (file_id))"


@query("onset_prf", " select file_id, hits, written, heard, round(\"precision\", 9) as \"precision\", round(recall, 9) as recall, round(f1, 9) as f1 from prf", _ONSETS + _PRF)
def _(spark, d):
    notes = notes_of(spark, d)
    rows = scoring.onset_scores(_heard(notes), _written(notes), 22)
    return rows.select("file_id", "hits", "written", "heard", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _ioi(name: str, source: str) -> str:
    return f", {name}0 as (select file_id, t - lag(t) over (partition by file_id order by t) as v from {source}), {name} as (select file_id, v / max(v) over (partition by file_id) as v from {name}0 where v is not null)"


_RHYTHM = (
    ", mo as (select distinct file_id, t from mi)"
    + _ioi("ia", "au")
    + _ioi("ib", "mo")
    + """, u as (select file_id, v, sum(a) as na, sum(b) as nb from (select file_id, v, 1 as a, 0 as b from ia union all select file_id, v, 0, 1 from ib) group by all),
cdf as (select file_id, v, sum(na) over w / sum(na) over (partition by file_id) as ca, sum(nb) over w / sum(nb) over (partition by file_id) as cb, lead(v) over (partition by file_id order by v) as nx from u window w as (partition by file_id order by v rows unbounded preceding)),
rhythm as (select file_id, greatest(0, 1 - coalesce(sum(abs(ca - cb) * (nx - v)), 0)) as rhythm from cdf group by file_id)"""
)


@query("rhythm_wasserstein", " select file_id, round(rhythm, 6) as rhythm from rhythm", _ONSETS + _RHYTHM)
def _(spark, d):
    notes = notes_of(spark, d)
    return scoring.rhythm_precision(_heard(notes), _written(notes).select("file_id", "t").distinct()).withColumn("rhythm", F.round("rhythm", 6))


_OVERALL = ", pl as (select file_id, case when avg(n) between 2 and 6 then 0.9 when avg(n) between 1 and 8 then 0.7 else 0.5 end as p from poly group by file_id), ov as (select file_id, 0.30 * f1 + 0.25 * 0.85 + 0.20 * 0 + 0.15 * p + 0.10 * rhythm as score from prf join pl using (file_id) join rhythm using (file_id))"


@query("overall_quality", " select file_id, round(score, 6) as score from ov", _ONSETS + _PRF + _RHYTHM + _GRID + _OVERALL)
def _(spark, d):
    return flows.quality(notes_of(spark, d)).select("file_id", F.round("score", 6).alias("score"))


@query(
    "quality_report",
    """, vals as (select *, 0.30 * f1 + 0.25 * 0.85 + 0.20 * 0 + 0.15 * p + 0.10 * rhythm as s from prf join pl using (file_id) join rhythm using (file_id))
    select file_id, 'Quality Report:' || chr(10) || repeat(chr(9472), 37) || chr(10) || printf('Onset F1 Score:        %.1f%%', 100 * f1) || chr(10) || 'Pitch Accuracy:        85.0%' || chr(10) || 'Spectral Similarity:   0.0%' || chr(10) || printf('Polyphony Score:       %.1f%%', 100 * p::double)
      || chr(10) || printf('Rhythmic Precision:    %.1f%%', 100 * rhythm) || chr(10) || repeat(chr(9472), 37) || chr(10) || printf('Overall Quality:       %.1f%%', 100 * s) || chr(10) || 'Rating: ' || case when s >= 0.9 then 'Excellent' when s >= 0.75 then 'Good' when s >= 0.6 then 'Fair' else 'Poor' end as text from vals""",
    _ONSETS + _PRF + _RHYTHM + _GRID + _OVERALL,
)
def _(spark, d):
    return scoring.report(flows.quality(notes_of(spark, d)))


@query("rating_bucket", " select file_id, case when score >= 0.9 then 'Excellent' when score >= 0.75 then 'Good' when score >= 0.6 then 'Fair' else 'Poor' end as rating from ov", _ONSETS + _PRF + _RHYTHM + _GRID + _OVERALL)
def _(spark, d):
    return flows.quality(notes_of(spark, d)).select("file_id", "rating")


# Dynamics and frames


_MM = ", mm as (select *, (value - min(value) over (partition by file_id)) / (max(value) over (partition by file_id) - min(value) over (partition by file_id) + 1e-8) as e from notes)"


@query("minmax_velocity", " select note_id, greatest(30, least(120, cast(trunc(30 + (0.7::double * e + 0.3::double * e) * 90) as int))) as velocity from mm", _MM)
def _(spark, d):
    rows = dynamics.minmax(notes_of(spark, d), "value", "e")
    return rows.select("note_id", M.velocity_blend(F.col("e"), F.col("e")).alias("velocity"))


_SMOOTH = ", sm as (select *, case when count(*) over (partition by file_id) < 3 then velocity else greatest(30, least(120, cast(trunc(sum(velocity) over (partition by file_id order by start_tick, note_id rows between 1 preceding and 1 following) / 3.0::double) as int))) end as smooth from notes)"


@query("velocity_smooth", " select note_id, smooth as velocity from sm", _SMOOTH)
def _(spark, d):
    return dynamics.smooth_velocity(notes_of(spark, d)).select("note_id", F.col("smooth").alias("velocity"))


@query("velocity_apply", ", nv as (select file_id, start_tick, pitch, channel, arg_max(smooth, note_id) as nv from sm where event_type <> 'view' group by all) select note_id, coalesce(nv, velocity) as velocity from notes left join nv using (file_id, start_tick, pitch, channel)", _SMOOTH)
def _(spark, d):
    smooth = dynamics.smooth_velocity(notes_of(spark, d))
    return dynamics.apply_velocity(notes_of(spark, d), smooth.where("event_type <> 'view'")).select("note_id", "velocity")


_FRAMES = ", frames as (select file_id, row_number() over (partition by file_id order by note_id) - 1 as frame, value as rms, velocity from notes)"


def frames_of(spark: SparkSession, d: str) -> DataFrame:
    """One frame an event, whose value is its energy."""
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("note_id")) - 1
    return notes_of(spark, d).select("file_id", nth.cast("long").alias("frame"), F.col("value").alias("rms"), F.col("value").alias("env"), "velocity")


@query("zscore_frames", " select file_id, frame, round((rms - avg(rms) over w) / (stddev_pop(rms) over w + 1e-8), 6) as z from frames window w as (partition by file_id)", _FRAMES)
def _(spark, d):
    return dynamics.zscore(frames_of(spark, d), "rms", "z").select("file_id", "frame", F.round("z", 6).alias("z"))


@query("energy_smooth", " select file_id, frame, round(sum(rms) over (partition by file_id order by frame rows between 2 preceding and 2 following) / 5, 6) as rms from frames", _FRAMES)
def _(spark, d):
    order = Window.partitionBy("file_id").orderBy("frame")
    return frames_of(spark, d).select("file_id", "frame", F.round(dynamics.moving_mean(F.col("rms"), order, 5), 6).alias("rms"))


@query("attack_slope", " select file_id, frame, round(case when frame < count(*) over (partition by file_id) - 5 then rms - coalesce(lag(rms, 2) over w, first_value(rms) over w) else 0 end, 6) as slope from frames window w as (partition by file_id order by frame)", _FRAMES)
def _(spark, d):
    return dynamics.attack_slope(frames_of(spark, d)).select("file_id", "frame", F.round("slope", 6).alias("slope"))


@query("peak_threshold", " select file_id, count(*) as above from (select *, avg(rms) over w + 0.5 * stddev_pop(rms) over w as thr from frames window w as (partition by file_id)) where rms >= thr group by file_id", _FRAMES)
def _(spark, d):
    return dynamics.peak_threshold(frames_of(spark, d)).where("env >= threshold").groupBy("file_id").agg(F.count("*").alias("above"))


@query(
    "audio_onsets",
    """, x0 as (select file_id, frame, rms, coalesce((rms - min(rms) over w) / nullif(max(rms) over w - min(rms) over w, 0), 0) as x from frames window w as (partition by file_id)),
    x1 as (select *, x >= max(x) over (o rows between 1 preceding and current row) and x >= avg(x) over (o rows between 4 preceding and 4 following) + 0.07 as peak,
      case when frame = 0 or rms <= lag(rms) over o and rms < lead(rms) over o then frame end as low from x0 window o as (partition by file_id order by frame)),
    x2 as (select *, last_value(low ignore nulls) over (partition by file_id order by frame rows unbounded preceding) as base from x1),
    x3 as (select *, frame - row_number() over (partition by file_id order by frame) as run from x2 where peak),
    x4 as (select *, row_number() over (partition by file_id, run order by frame) as nth from x3)
    select file_id, frame as peak, base as frame, round(base * 512 / 22050.0, 6) as t from x4 where nth % 2 = 1""",
    _FRAMES,
)
def _(spark, d):
    return dynamics.onsets(frames_of(spark, d)).withColumn("t", F.round("t", 6))


@query(
    "peak_pick",
    """, th as (select *, avg(rms) over w + 0.5 * stddev_pop(rms) over w as thr, lag(rms) over (partition by file_id order by frame) as prev from frames window w as (partition by file_id)),
    pl as (select *, sum(case when rms = prev then 0 else 1 end) over (partition by file_id order by frame) as plateau from th),
    fl as (select file_id, plateau, min(frame) as i, max(frame) as j, min(rms) as v, arg_min(thr, frame) as thr from pl group by all),
    tp as (select file_id, (i + j) // 2 as frame, v from (select *, lag(v) over o as b, lead(v) over o as a from fl window o as (partition by file_id order by plateau)) where v > b and v > a and v >= thr),
    kp as (select file_id, list_reduce(list([struct_pack(f := frame, v := v)] order by v desc, frame desc), lambda kept, x: case when len(list_filter(kept, lambda k: abs(k.f - x[1].f) < 5)) = 0 then list_concat(kept, x) else kept end) as kept from tp group by file_id),
    out as (select file_id, unnest(kept) as k from kp)
    select file_id, k.f as frame, k.v as value from out""",
    _FRAMES,
)
def _(spark, d):
    return hands.peaks(dynamics.peak_threshold(frames_of(spark, d)))


@query("resonance_following", " select file_id, frame, round(avg(rms) over (partition by file_id order by frame rows between current row and 9 following), 6) as mean from frames", _FRAMES)
def _(spark, d):
    return dynamics.following_mean(frames_of(spark, d), "rms", "mean").select("file_id", "frame", F.round("mean", 6).alias("mean"))


def _snaps(spark, d):
    frames = frames_of(spark, d)
    ends = frames.select((F.col("frame") * 100_000 + F.col("file_id")).alias("note_id"), "file_id", "frame")
    return dynamics.snap_offsets(ends, frames, tolerance=3).select("note_id", "file_id", "frame_end")


for _name in ("energy_offset_snap", "energy_offset_snap_all"):
    query(
        _name,
        ", n2 as (select frame * 100000 + file_id as note_id, file_id, frame, rms from frames), c as (select n2.note_id, n2.frame, min(f.frame) as \"to\" from n2 join frames f on f.file_id = n2.file_id and f.frame between n2.frame - 5 and n2.frame + 4 and f.rms < 0.3 * n2.rms group by all) select n2.note_id, n2.file_id, coalesce(case when abs(c.\"to\" - c.frame) <= 3 then c.\"to\" end, n2.frame) as frame_end from n2 left join c on c.note_id = n2.note_id",
        _FRAMES,
    )(_snaps)


_SNR = ", pc as (select file_id, quantile_cont(rms, 0.25) as p25, quantile_cont(rms, 0.75) as p75 from frames group by file_id)"


@query("snr_percentiles", " select file_id, round(p25, 6) as p25, round(p75, 6) as p75, round(p75 / (p25 + 1e-6), 6) as snr from pc", _FRAMES + _SNR)
def _(spark, d):
    rows = dynamics.energy_percentiles(frames_of(spark, d))
    return rows.select("file_id", F.round("p25", 6).alias("p25"), F.round("p75", 6).alias("p75"), F.round(F.col("p75") / (F.col("p25") + F.lit(1e-6)), 6).alias("snr"))


@query(
    "adaptive_params",
    ", o as (select file_id, 60 + file_id * 8 as tempo, case when p75 / (p25 + 1e-6) < 3 then 0.6 when p75 / (p25 + 1e-6) > 10 then 0.45 else 0.5 end::double as onset from pc) select file_id, onset, round(onset - 0.2, 6) as frame, case when tempo > 140 then 97.7 when tempo < 80 then 147.7 else 127.7 end::double as length from o",
    _FRAMES + _SNR,
)
def _(spark, d):
    stats = dynamics.energy_percentiles(frames_of(spark, d)).withColumn("tempo", 60 + F.col("file_id") * 8)
    return dynamics.adaptive_parameters(stats).select("file_id", "onset", F.round("frame", 6).alias("frame"), F.round("length", 6).alias("length"))


QUERIES["cosine_frames"] = lambda spark, d: scoring.chroma_similarity(*flows.paired_embeddings(spark, d)).withColumn("chroma", F.round("chroma", 6))
SQL["cosine_frames"] = """
with a as (select cast(vec_id % 8 as int) as file_id, vec_id // 16 as frame, embedding as c from embeddings where vec_id % 16 < 8), b as (select cast(vec_id % 8 as int) as file_id, vec_id // 16 as frame, embedding as c from embeddings where vec_id % 16 >= 8)
select file_id, round(coalesce(avg(greatest(0, list_cosine_similarity(a.c::double[], b.c::double[]))), 0), 6) as chroma from a join b using (file_id, frame) group by file_id"""


# Hands and groups


@query("median_split", " select file_id, greatest(48, least(72, cast(trunc(quantile_cont(pitch, 0.5)) as int))) as split from notes group by file_id")
def _(spark, d):
    return hands.median_split(notes_of(spark, d))


_GROUPS = """, o as (select file_id, start_tick, note_id, row_number() over (partition by file_id order by start_tick, note_id) as i from notes),
    a as (select file_id, min(start_tick) as anchor, 1 as grp from o group by file_id union all select a.file_id, (select min(start_tick) from o where o.file_id = a.file_id and o.start_tick > a.anchor + 48), a.grp + 1 from a where a.anchor is not null),
    grouped as materialized (select o.file_id, o.note_id, max(a.grp) as grp from o join a on a.file_id = o.file_id and a.anchor <= o.start_tick group by o.file_id, o.note_id)"""


@query("anchor_groups", 'recursive: select file_id, note_id, grp as "group" from grouped', _GROUPS)
def _(spark, d):
    return temporal.anchor_groups(notes_of(spark, d), 48, ["file_id"], "start_tick", "note_id").select("file_id", "note_id", "group")


def _cost(hand: str, loud: str, across: str) -> str:
    """What a hand (its last five pitches and groups) asks for the chord x.m, x.v of group x.grp."""
    p, g = f"{hand}p", f"{hand}g"
    weight, jump = f"pow(0.9, x.grp - {g}[i])", f"abs(x.m - {p}[i])"
    step = f"case when {jump} <= 2 then {jump} when {jump} <= 7 then 2 * {jump} else 3 * {jump} end"
    flow = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: {weight} * ({step}))) / list_sum(list_transform(range(1, len({p}) + 1), lambda i: {weight}))"
    wide = f"case when greatest(list_max({p}), x.m) - least(list_min({p}), x.m) > 12 then 50 else 0 end"
    return f"case when len({p}) = 0 then abs(x.m - x.split) else 0.7::double * ({flow}) + {wide} + 0.3::double * ({loud}) + (1 - 0.7::double - 0.3::double) * (abs(x.m - x.split) + case when {across} then 5 else 0 end) end"


_HANDS = (
    _GROUPS
    + f""", sp as (select file_id, greatest(48, least(72, cast(trunc(quantile_cont(pitch, 0.5)) as int))) as split from notes group by file_id),
    gl as materialized (select file_id, grp, any_value(split) as split, list(pitch order by start_tick, note_id) as ps, list(note_id order by start_tick, note_id) as ids, avg(pitch) as m, avg(velocity) as v from grouped join notes using (file_id, note_id) join sp using (file_id) group by file_id, grp),
    walk as (
      select file_id, 0::bigint as grp, []::int[] as lp, []::bigint[] as lg, []::int[] as rp, []::bigint[] as rg, []::bigint[] as ids, []::boolean[] as lefts from sp
      union all
      select y.file_id, y.grp, list_concat(lp, ls)[-5:], list_concat(lg, list_transform(ls, lambda p: y.grp))[-5:], list_concat(rp, rs)[-5:], list_concat(rg, list_transform(rs, lambda p: y.grp))[-5:], y.ids, y.lefts
      from (
        select z.*, list_filter(z.ps, lambda p, i: z.lefts[i]) as ls, list_filter(z.ps, lambda p, i: not z.lefts[i]) as rs from (
          select x.file_id, x.grp, x.ps, x.ids, w.lp, w.lg, w.rp, w.rg,
            case when len(x.ps) > 1 and list_max(x.ps) - list_min(x.ps) > 12 then list_transform(x.ps, lambda p: p < x.split)
            else list_transform(x.ps, lambda p: x.m < x.split - 5 or (x.m <= x.split + 5 and {_cost("l", "10 * x.v / 127", "x.m >= x.split")} < {_cost("r", "10 * (1 - x.v / 127)", "x.m < x.split")})) end as lefts
          from walk w join gl x on x.file_id = w.file_id and x.grp = w.grp + 1
        ) z
      ) y
    ), taken as (select file_id, unnest(ids) as note_id, unnest(lefts) as is_left from walk)"""
)


def _hands(spark, d):
    notes = notes_of(spark, d)
    return hands.separate(notes, temporal.anchor_groups(notes, 48, ["file_id"], "start_tick", "note_id"), hands.median_split(notes))


query("hands_assign", "recursive: select note_id, file_id, case when is_left then 'left' else 'right' end as hand, is_left::int as track from taken", _HANDS)(_hands)


@query("notes_per_hand", "recursive: select file_id, is_left::int as track, count(*) as notes from taken group by all", _HANDS)
def _(spark, d):
    return _hands(spark, d).groupBy("file_id", "track").agg(F.count("*").alias("notes"))


# Phrases


_NGRAM = """, arr as (select file_id, list(pitch order by start_tick, note_id) as p, list(start_tick order by start_tick, note_id) as s, count(*) as n from notes group by file_id),
f0 as (select *, unnest(range(0, n - len + 1)) as pos from (select *, unnest(range(8, 21)) as len from arr) where len < n),
f1 as (select file_id, pos, len, list_transform(range(1, len), lambda i: p[pos + i + 1] - p[pos + i]) as ivs, list_transform(range(1, len), lambda i: s[pos + i + 1] - s[pos + i]) as ioi, p[pos + 1] as p0 from f0),
fr as (select file_id, pos::int as pos, len::int as len, ivs, list_transform(ioi, lambda x: round_even(x / greatest(list_min(ioi), case when list_min(ioi) > 0 then 0 else 1 end), 0)::int) as rhythm, p0 from f1),
cn as (select file_id, len, ivs, rhythm, p0, count(*) as cnt, min(pos) as first_pos from fr group by all)"""
_TOP = ", tp as (select *, cast(row_number() over (partition by file_id order by cnt desc, len, first_pos) as int) as rank from cn), top as (select * from tp where rank <= 100)"


_COUNTED = " select file_id, len, array_to_string(ivs, ' ') as ivs, p0, array_to_string(rhythm, ' ') as rhythm, cnt, first_pos from cn"


def _counts(spark, d, **options):
    rows = phrases.pattern_counts(phrases.windows(notes_of(spark, d), **options))
    return rows.select("file_id", "len", F.array_join("ivs", " ").alias("ivs"), "p0", F.array_join("rhythm", " ").alias("rhythm"), "cnt", "first_pos")


for _name in ("ngram_count", "ngram_count_all"):
    query(_name, _COUNTED, _NGRAM)(_counts)


@query("ngram_count_sparse", _COUNTED, _NGRAM.replace("range(0, n - len + 1)", "range(0, n - len + 1, case when n > 500 then 2 else 1 end)"))
def _(spark, d):
    return _counts(spark, d, sparse_above=500)


def _rhythms(spark, d):
    return phrases.frames(notes_of(spark, d)).select("file_id", "pos", "len", F.array_join("rhythm", " ").alias("rhythm"))


for _name in ("ngram_rhythm_norm", "ngram_rhythm_norm_all"):
    query(_name, " select file_id, pos, len, array_to_string(rhythm, ' ') as rhythm from fr", _NGRAM)(_rhythms)


@query("top100_patterns", " select file_id, rank, len, p0, array_to_string(ivs, ' ') as ivs, cnt from top", _NGRAM + _TOP)
def _(spark, d):
    rows = phrases.best_patterns(notes_of(spark, d))
    return rows.select("file_id", "rank", "len", "p0", F.array_join("ivs", " ").alias("ivs"), "cnt")


@query(
    "edit_similarity_pairs",
    """, c as (select file_id, len, rank, array_to_string(list_transform(ivs, lambda v: chr(64 + v)), '') as code from top),
    e as (select a.file_id, a.len, a.rank as rank_a, b.rank as rank_b, 1 - levenshtein(a.code, b.code) / (a.len - 1) as similarity from c a join c b on a.file_id = b.file_id and a.len = b.len and a.rank < b.rank)
    select file_id, len, rank_a, rank_b, round(similarity, 6) as similarity from e where similarity >= 0.75""",
    _NGRAM + _TOP,
)
def _(spark, d):
    return phrases.similar_pairs(phrases.best_patterns(notes_of(spark, d)))


@query(
    "phrase_score",
    """, x as (select *, len(ivs) as k, list_transform(range(0, len(ivs) + 1), lambda i: coalesce(list_sum(ivs[1:i]), 0)) as path, len(list_filter(ivs, lambda v: v = 0)) / len(ivs) as rep, len(list_filter(ivs, lambda v: abs(v) <= 2)) / len(ivs) as st from top),
    y as (select *, k + 1 as n, list_max(path) - list_min(path) as w from x)
    select file_id, rank, round(greatest(0, 2 * ln(1 + cnt) + 5 * least(n / 12, 12 / n) + case when n < 6 then -8 when n < 8 then -3 else 0 end + case when n between 10 and 16 then 3 when n between 8 and 20 then 1.5 else 0 end
      + 2.5 * (1 - abs(st - 0.7)) - case when rep > 0.5 then 3 when rep > 0.3 then 1 else 0 end + 1.5 * least(len(list_distinct(rhythm)) / 3, 1) + case when w >= 3 then 2 * least(w / 12, 1) else -1 end + case when p0 < 36 or p0 > 84 then -1 else 0 end), 6) as score from y""",
    _NGRAM + _TOP,
)
def _(spark, d):
    rows = phrases.best_patterns(notes_of(spark, d))
    return rows.select("file_id", "rank", F.round(phrases.score(F.col("cnt"), F.col("ivs"), F.col("rhythm"), F.col("p0")), 6).alias("score"))


@query(
    "pattern_first_occurrence",
    """, g0 as (select *, unnest(range(0, n - len + 1)) as pos from (select *, unnest(range(8, 21)) as len from arr) where len < n),
    g1 as (select file_id, pos, len::int as len, list_transform(range(1, len), lambda i: p[pos + i + 1] - p[pos + i]) as ivs, p[pos + 1] as p0 from g0)
    select file_id, rank, min(g1.pos)::int as pos from top join g1 using (file_id, len, p0, ivs) group by all""",
    _NGRAM + _TOP,
)
def _(spark, d):
    notes = notes_of(spark, d)
    top = phrases.best_patterns(notes).select("file_id", "rank", "len", "p0", "ivs")
    return phrases.first_occurrence(notes, top)


# The leaders so far of each file, rank by rank; a pattern joins the first of them that is similar.
_LED = """, cd as (select file_id, len, rank, array_to_string(list_transform(ivs, lambda v: chr(64 + v)), '') as code from top),
alike as (select a.file_id, b.rank, list(a.rank) as before from cd a join cd b on a.file_id = b.file_id and a.len = b.len and a.rank < b.rank and 1 - levenshtein(a.code, b.code) / (a.len - 1) >= 0.75 group by all),
walk as (
  select file_id, 1 as rank, [1] as leaders, 1 as leader from top where rank = 1 union all
  select w.file_id, w.rank + 1, case when list_min(list_intersect(w.leaders, coalesce(k.before, []))) is null then list_append(w.leaders, w.rank + 1) else w.leaders end,
    coalesce(list_min(list_intersect(w.leaders, coalesce(k.before, []))), w.rank + 1)
  from walk w join top t on t.file_id = w.file_id and t.rank = w.rank + 1 left join alike k on k.file_id = w.file_id and k.rank = w.rank + 1
), led as (select file_id, leader::int as leader, count(*)::int as members, sum(cnt)::bigint as frequency from walk join top using (file_id, rank) group by file_id, leader)"""
_SCORED = """, x as (select *, len(ivs) as k, list_transform(range(0, len(ivs) + 1), lambda i: coalesce(list_sum(ivs[1:i]), 0)) as path, len(list_filter(ivs, lambda v: v = 0)) / len(ivs) as rep, len(list_filter(ivs, lambda v: abs(v) <= 2)) / len(ivs) as st
  from led join (select * exclude (cnt), rank as leader from top) using (file_id, leader)),
y as (select *, k + 1 as n, list_max(path) - list_min(path) as w from x),
z as (select *, round(greatest(0, 2 * ln(1 + frequency) + 5 * least(n / 12, 12 / n) + case when n < 6 then -8 when n < 8 then -3 else 0 end + case when n between 10 and 16 then 3 when n between 8 and 20 then 1.5 else 0 end
  + 2.5 * (1 - abs(st - 0.7)) - case when rep > 0.5 then 3 when rep > 0.3 then 1 else 0 end + 1.5 * least(len(list_distinct(rhythm)) / 3, 1) + case when w >= 3 then 2 * least(w / 12, 1) else -1 end + case when p0 < 36 or p0 > 84 then -1 else 0 end), 6) as score from y),
b as (select *, row_number() over (partition by file_id order by score desc, leader)::int as place from z)"""


@query("phrase_leader_groups", " recursive:select file_id, leader, members, frequency from led", _NGRAM + _TOP + _LED)
def _(spark, d):
    return phrases.leader_groups(phrases.best_patterns(notes_of(spark, d)))


@query("best_phrases", " recursive:select file_id, place as rank, score, frequency, len, p0, array_to_string(ivs, ' ') as ivs, case when members = 1 then 'exact' else 'similar' end as pattern_type from b where place <= 5", _NGRAM + _TOP + _LED + _SCORED)
def _(spark, d):
    return phrases.best_phrases(notes_of(spark, d)).withColumn("ivs", F.array_join("ivs", " "))


# Scalar functions


@query(
    "scalar_functions",
    f""" select note_id, cast(pitch % 12 as int) as pc, cast(pitch // 12 - 1 as int) as octave, ({M.NOTE_NAMES})[pitch % 12 + 1] || (pitch // 12 - 1) as name, round(440 * pow(2, (pitch - 69) / 12.0), 6) as hz,
    cast(round_even(start_tick * 0.01 * 1e6 * 220 / 500000, 0) as bigint) as tick, cast(start_tick // 880 + 1 as int) as measure, (start_tick // 220) * 220 as beat, cast(round_even(60000000.0 / (400000 + note_id % 100 * 2000), 0) as int) as bpm,
    cast(round_even(60000000.0 / (60 + note_id % 100), 0) as int) as tempo, round(start_tick * 512 / 22050.0, 6) as t, cast(floor(start_tick * 0.01 * 22050 / 512) as int) as frame, round(greatest(20 * log10(greatest(1e-5, value) / 490.0), -80), 6) as db from notes""",
)
def _(spark, d):
    p, s, k = F.col("pitch"), F.col("start_tick"), F.col("note_id") % 100
    return notes_of(spark, d).select(
        "note_id", M.pitch_class(p).alias("pc"), M.octave(p).alias("octave"), M.note_name(p).alias("name"), F.round(M.midi_to_hz(p), 6).alias("hz"), M.second_to_tick(s * F.lit(0.01)).alias("tick"), M.measure(s).alias("measure"),
        M.grid_floor(s, 220).alias("beat"), M.tempo_to_bpm(400_000 + k * 2_000).alias("bpm"), M.bpm_to_tempo(60 + k).alias("tempo"), F.round(M.frame_to_time(s), 6).alias("t"), M.time_to_frame(s * F.lit(0.01)).alias("frame"), F.round(M.amplitude_db(F.col("value"), F.lit(490.0)), 6).alias("db"),
    )


# Files and recordings, rows only


def _audio(spark, d):
    """All notes of each file, rendered in chunks."""
    return signal.render_chunks(seconds_of(notes_of(spark, d)))


@query(
    "smf_roundtrip",
    """, k as (select file_id, 'note_on' as kind, count(*) as n, max(start_tick) as last_tick from notes group by file_id union all select file_id, 'note_off', count(*), max(end_tick) from notes group by file_id
      union all select file_id, 'set_tempo', 1, 0 from notes group by file_id union all select file_id, 'end_of_track', count(distinct track), max(end_tick) from notes group by file_id)
    select file_id, kind, n, last_tick from k""",
)
def _(spark, d):
    back = smf.messages(smf.write(pairing.note_events(notes_of(spark, d))))
    return back.groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.max("abs_tick").alias("last_tick"))


@query(
    "chord_files",
    """, v as (select file_id, t as s, t + greatest(dur, 220) as e from voiced)
    select file_id, 'note_on' as kind, count(*) as n, max(s) as last_tick from v group by file_id union all select file_id, 'note_off', count(*), max(e) from v group by file_id
    union all select file_id, unnest(['set_tempo', 'time_signature', 'track_name']), 1, 0 from v group by file_id union all select file_id, 'end_of_track', 1, max(e) from v group by file_id""",
    _CHORDS + _DURS,
)
def _(spark, d):
    files = smf.write_chords(harmony.voicing(harmony.identify_chords(notes_of(spark, d)), "block"), tpb=M.TICKS_PER_BEAT)
    return smf.messages(files).groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.max("abs_tick").alias("last_tick"))


@query(
    "phrase_files",
    """recursive:, occ as (select file_id, min(g.pos) as pos, any_value(len) as len from b join (select file_id, unnest(range(0, n - len + 1)) as pos, len, p, n from (select *, unnest(range(8, 21)) as len from arr) where len < n) g using (file_id, len)
      where place = 1 and g.p[g.pos + 1] = b.p0 and list_transform(range(1, len), lambda i: g.p[g.pos + i + 1] - g.p[g.pos + i]) = b.ivs group by file_id),
    nt as (select *, row_number() over (partition by file_id order by start_tick, note_id) - 1 as nth from notes),
    ph as (select file_id, start_tick - min(start_tick) over (partition by file_id) as s, end_tick - min(start_tick) over (partition by file_id) as e from nt join occ using (file_id) where nth between pos and pos + len - 1)
    select file_id, 'note_on' as kind, count(*) as n, max(s) as last_tick from ph group by file_id union all select file_id, 'note_off', count(*), max(e) from ph group by file_id
    union all select file_id, unnest(['track_name', 'set_tempo']), 1, 0 from ph group by file_id union all select file_id, 'end_of_track', 1, max(e) from ph group by file_id""",
    _NGRAM + _TOP + _LED + _SCORED,
)
def _(spark, d):
    notes = notes_of(spark, d)
    files = smf.write_phrases(phrases.phrase_notes(notes, phrases.best_phrases(notes, 1)), "file_id")
    return smf.messages(files).groupBy("file_id", "kind").agg(F.count("*").alias("n"), F.max("abs_tick").alias("last_tick"))


@query(
    "output_paths",
    " select note_id, 'out/midi/chords/' || event_type || '.' || pitch || '_chords.mid' as chords, 'out/phrases/' || event_type || '.' || pitch || '.mid' as phrases from notes",
)
def _(spark, d):
    stem = layout.stem(F.concat(F.lit("in/songs/"), "event_type", F.lit("."), F.col("pitch").cast("string"), F.lit(".mp3")))
    return notes_of(spark, d).select("note_id", layout.output_path("chords", stem, "out").alias("chords"), layout.output_path("phrases", stem, "out").alias("phrases"))


QUERIES["synth_render"] = lambda spark, d: _audio(spark, d).groupBy("file_id", "sr").agg(F.sum("samples").alias("samples"), F.round(F.max(F.array_max(F.slice("y", F.col("lead") + 1, F.col("samples").cast("int")))).cast("double"), 4).alias("peak"))
QUERIES["wav_frames"] = lambda spark, d: signal.frames(_audio(spark, d)).groupBy("file_id").agg(F.count("*").alias("frames"), F.round(F.max("rms"), 6).alias("rms"))
@query(
    "pedal_refine_audio",
    """, zs as (select file_id, frame, ((rms - avg(rms) over w) / (stddev_pop(rms) over w + 1e-8) + (velocity - avg(velocity) over w) / (stddev_pop(velocity) over w + 1e-8)) / 2 as z from frames window w as (partition by file_id)),
    fm as (select file_id, frame, avg(z) over (partition by file_id order by frame rows between current row and 9 following) as m, max(frame) over (partition by file_id) as last from zs),
    k as (select *, lead(t) over w as nx, lag(t) over w as pv, lag(down) over w as was, count(*) over (partition by file_id) as c from fin window w as (partition by file_id order by t)),
    ev as (select file_id, t, down from k where c < 2 or not (coalesce(down and nx - t < 0.5, false) or coalesce(not down and was and t - pv < 0.5, false)))
    select ev.file_id, round(t, 6) as t, down from ev join fm on fm.file_id = ev.file_id and fm.frame = least(greatest(ceil(t - 0.5), 0), fm.last) where not down or fm.frame >= fm.last - 9 or m > -0.5""",
    _PEDAL + _FRAMES,
)
def _(spark, d):
    frames = dynamics.resonance(frames_of(spark, d).withColumnsRenamed({"rms": "centroid", "velocity": "rolloff"}))
    return dynamics.refine_pedal(dynamics.detect_pedal(_long_seconds(notes_of(spark, d))), frames, sr=1, hop=1).withColumn("t", F.round("t", 6))


QUERIES["transcribe_backend"] = lambda spark, d: signal.transcribe(signal.separate(_audio(spark, d)))
QUERIES["band_energy"] = lambda spark, d: signal.note_features(_audio(spark, d), seconds_of(notes_of(spark, d))).select("note_id", F.round("energy", 4).alias("energy"))


def _written_audio(spark, d):
    """Recordings of all notes, and the notes of track 0 as what was written of them."""
    return _audio(spark, d), seconds_of(notes_of(spark, d)).where("track = 0")


@query("quality_of_audio")
def _(spark, d):
    _, written = _written_audio(spark, d)
    rows = flows.quality_of_audio(signal.render_chunks(seconds_of(notes_of(spark, d)), beyond=signal.REACH), written)
    return rows.select("file_id", *(F.round(c, 6).alias(c) for c in ("f1", "pitch", "chroma", "polyphony", "rhythm", "score")), "rating")


@query("velocity_of_audio")
def _(spark, d):
    return flows.enhance_velocities(*_written_audio(spark, d)).select("note_id", "velocity")


@query("timing_of_audio")
def _(spark, d):
    return flows.refine_timing(*_written_audio(spark, d)).select("note_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("parameters_of_audio")
def _(spark, d):
    rows = flows.parameters_of_audio(_audio(spark, d), seconds=None)
    return rows.select("file_id", *(F.round(c, 6).alias(c) for c in ("snr", "tempo", "onset", "frame", "length")))
