"""Queries over forms of notation and of tokens that the driver's tables don't hold by themselves: an event picks a form by its
id, and lanes follow from it. What each form gives is worked out by hand and stands beside it, so the SQL reads no notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions import notes as N
from metrolith.functions import quantize as Q
from metrolith.functions import vocabulary as V
from metrolith.operators import augment, decode, matching, metrics, parse, split, windows
from metrolith.plans import charts
from metrolith.plans import tables as T
from metrolith.plans.named import query
from metrolith.plans.tables import MEMBERS, NOTES, TEN, table, token_sql

_text = lambda c: F.array_join(c, " ")

#: A slot at 120 beats a minute, and its notes: type, lane or area, hold in centiseconds, marks (f, b, x), segments. `%a` is the
#: event's lane, `%m` two lanes on, `%e` four. A segment: shape, start, middle, end, wait and trace in centiseconds, turn, and
#: bits for a forced star, a fake rotation, a break and no head.
FORMS = [
    ("%a-%e[8:3]", ["SLIDE,,,,Line:%a:-:%e:200:75:-:0000"]),
    ("%a>%e[4:3]", ["SLIDE,,,,Circle:%a:-:%e:200:150:1:0000"]),
    ("%a<%e[4:3]", ["SLIDE,,,,Circle:%a:-:%e:200:150:0:0000"]),
    ("%a^%m[8:1]", ["SLIDE,,,,Circle:%a:-:%m:200:25:-:0000"]),
    ("%av%m[8:1]", ["SLIDE,,,,V:%a:-:%m:200:25:-:0000"]),
    ("%aV%m%e[2:1]", ["SLIDE,,,,GrandV:%a:%m:%e:200:100:-:0000"]),
    ("%ap%e[8:1]", ["SLIDE,,,,P:%a:-:%e:200:25:-:0000"]),
    ("%aq%e[8:1]", ["SLIDE,,,,Q:%a:-:%e:200:25:-:0000"]),
    ("%aqq%eb[8:1]", ["SLIDE,,,b,QQ:%a:-:%e:200:25:-:0010"]),
    ("%as%e[8:1]/%az%e[8:1]/%aw%e[8:1]", ["SLIDE,,,,S:%a:-:%e:200:25:-:0000", "SLIDE,,,,Z:%a:-:%e:200:25:-:0000", "SLIDE,,,,Wifi:%a:-:%e:200:25:-:0000"]),
    ("%a-%e*>%m[8:5]b", ["SLIDE,,,b,Line:%a:-:%e:200:0:-:0010|Circle:%a:-:%m:200:125:1:0010"]),
    ("?%a-%e[2:1]", ["SLIDE,,,,Line:%a:-:%e:200:100:-:0001"]),
    ("%a$-%ex[8:3]", ["SLIDE,,,x,Line:%a:-:%e:200:75:-:1000"]),
    ("%a@$$pp%e[160#2]", ["SLIDE,,,,PP:%a:-:%e:150:200:-:0101"]),
    ("%a-%eq%m[1:2]", ["SLIDE,,,,Line:%a:-:%e:200:0:-:0000|Q:%e:-:%m:200:400:-:0000"]),
    ("%a-%e%m[3##1.5]", ["SLIDE,,,,Line:%a:-:%e:200:0:-:0000|Line:%e:-:%m:300:133:-:0000"]),
    ("%aV%m%e%a%m[8:1]", ["SLIDE,,,,GrandV:%a:%m:%e:200:0:-:0000|GrandV:%e:%a:%m:200:25:-:0000"]),
    ("A%af/C2/E%a", ["TOUCH,A%a,,f,", "TOUCH,C,,,", "TOUCH,E%a,,,"]),
    ("B%ah[2:1]f", ["TOUCH_HOLD,B%a,100,f,"]),
    ("%a%m%eb", ["TAP,%a,,,", "TAP,%m,,,", "TAP,%e,,b,"]),
    ("%abx/%ehx[4:1]", ["TAP,%a,,bx,", "HOLD,%e,50,x,"]),
    ("%a`%mh[#1.5]", ["TAP,%a,,,", "HOLD,%m,150,,"]),
    ("%a || %m, %e ||no note", ["TAP,%a,,,", "TAP,%e,,,"]),
]
#: A slot, and the reason of its error or the kinds of its warnings.
FAULTS = [("2p", "!note"), ("9", "!note"), ("F1", "!note"), ("A9", "!note"), ("%a-%e*", "!note"), ("%a-%e[#2]", "!note"), ("1V3[8:1]", "!note"), (",(x)%a", "!tempo"), (",{0}%a", "!tempo"), ("%ah", "pseudo-hold"), ("E%ah", "pseudo-touch-hold"), ("%a$", "star-tap"), ("%a[4:1]", "tap-duration"), ("%a/", "empty-each"), ("%a`%e", "pseudo-each"), ("%a-%e%m[8:1]", "missing-slide-shape"), ("{2}}%ah[4:1]", "extra-brace"), ("%a$/%m`%eh", "pseudo-each pseudo-hold star-tap"), ("%a", "")]
#: A token sequence, and what reading it warns of, the frames and notes it has, and the lane of the first. `%a` is a lane's token.
TOKENS = [
    ("1 3 5 3046 9 4 2", "TAP: lane", 1, 1, "1"),
    ("3 3046 %a 4", "frame: time", 1, 1, "%l"),
    ("3 105 3046 %a", "frame: end mark", 1, 1, "%l"),
    ("3 105 3048 %a 3063 4", "HOLD: time", 1, 1, "%l"),
    ("3 105 4 7", "outside: unknown token", 0, 0, ""),
    ("3 105 3046 %a 4 2 3 106 3046 %a 4", "", 1, 1, "%l"),
    ("1 0 3 205 3046 %a 4 3 105 3048 %a 30 3046 %a 4 2", "", 2, 3, "%l"),
    ("3 105 3047 3013 4 3 105 3049 4", "SLIDE: empty", 2, 2, ""),
    ("", "", 0, 0, ""),
]

_LANES = "CAST(event_id % 8 + 1 AS VARCHAR) AS a, CAST((event_id + 2) % 8 + 1 AS VARCHAR) AS m, CAST((event_id + 4) % 8 + 1 AS VARCHAR) AS e"


def _filled(text: Column) -> Column:
    lane = lambda n: ((F.col("event_id") + n) % 8 + 1).cast("string")
    return F.replace(F.replace(F.replace(text, F.lit("%a"), lane(0)), F.lit("%m"), lane(2)), F.lit("%e"), lane(4))


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(quoted(x) for x in row) + ")" for row in rows)


def _form(forms: list[str]) -> Column:
    return F.get(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % len(forms)).cast("int"))


def _parsed(spark: SparkSession, d: str, forms: list[str]) -> parse.Parsed:
    """Each event as a chart of its own."""
    text = F.concat(F.lit("&inote_5=(120){4}"), _filled(_form(forms)), F.lit(",E"))
    return parse.parse(table(spark, d, "events").select(F.col("event_id").alias("chart"), text.alias("text")), (5,), held=True)


_FORMS_SQL = f"""WITH f(i, place, t) AS (VALUES {_values([(i, k, n) for i, (_, notes) in enumerate(FORMS) for k, n in enumerate(notes)])}), l AS (SELECT event_id, {_LANES} FROM events)
  SELECT event_id, place, replace(replace(replace(t, '%a', a), '%m', m), '%e', e) AS note FROM l JOIN f ON i = event_id % {len(FORMS)}"""


def _told(frames: DataFrame) -> DataFrame:
    """event_id, place, and each note in words; frames: of parse."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("time_sec", "notes"))), lambda f: f["notes"]))
    each = frames.groupBy(F.col("chart").alias("event_id")).agg(ordered.alias("notes")).select("event_id", F.posexplode("notes").alias("place", "n"))
    bit = lambda c: c.cast("int").cast("string")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    segment = lambda s: F.concat_ws(
        ":", s["shape"], s["start_lane"], dash(s["middle_lane"]), s["end_lane"], Q.centiseconds(s["wait_sec"]), Q.centiseconds(s["trace_sec"]), dash(s["cw"].cast("int")),
        F.concat(bit(s["force_star"]), bit(s["fake_rotate"]), bit(s["slide_break"]), bit(s["no_head"])),
    )
    marks = F.concat(F.when(F.col("n.firework"), "f").otherwise(""), F.when(F.col("n.is_break"), "b").otherwise(""), F.when(F.col("n.is_ex"), "x").otherwise(""))
    none = F.lit("")
    spot = F.coalesce(F.col("n.lane").cast("string"), F.col("n.area"), none)
    hold = F.coalesce(Q.centiseconds(F.col("n.hold_sec")).cast("string"), none)
    return each.select("event_id", "place", F.concat_ws(",", "n.type", spot, hold, marks, F.coalesce(F.array_join(F.transform("n.segments", segment), "|"), none)).alias("note"))


@query("notation_forms", _FORMS_SQL)
def notation_forms(spark: SparkSession, d: str) -> DataFrame:
    """Notes of all shapes, chains, branches, touches, written together, and behind comments: a table of forms with results
    worked out by hand, so the SQL is that table and no reader of its own."""
    return _told(_parsed(spark, d, [f for f, _ in FORMS]).frames)


#: Lengths are written with the first denominator that fits within two per cent: 21/16 for 2 s of 1.5, 7/16 for 1.333 s of 3.
_BACK_SQL = _FORMS_SQL.replace(":150:200:", ":150:197:").replace(":300:133:", ":300:131:")


@query("notes_written_back", _BACK_SQL)
def notes_written_back(spark: SparkSession, d: str) -> DataFrame:
    """The same notes, written in notation and read again."""
    frames = _parsed(spark, d, [f for f, _ in FORMS]).frames
    text = F.array_join(F.transform("notes", lambda n: N.written(n, 120.0)), "/")
    rows = frames.groupBy("chart").agg(F.array_sort(F.collect_list(F.struct("time_sec", text.alias("text")))).alias("all"))
    again = rows.select("chart", F.concat(F.lit("&inote_5=(120){4}"), F.array_join("all.text", ","), F.lit(",E")).alias("text"))
    return _told(parse.parse(again, (5,), held=True).frames)


@query("notation_faults", f"""WITH f(i, told) AS (VALUES {_values([(i, x) for i, (_, x) in enumerate(FAULTS)])}) SELECT event_id, told FROM events JOIN f ON i = event_id % {len(FAULTS)} WHERE told <> ''""")
def notation_faults(spark: SparkSession, d: str) -> DataFrame:
    """Of each event's chart the reason why it can't be read, or else the kinds of warnings."""
    p = _parsed(spark, d, [f for f, _ in FAULTS])
    errors = p.errors.select(F.col("chart").alias("event_id"), F.concat(F.lit("!"), "reason").alias("told"))
    warned = p.warnings.join(p.errors.select("chart"), "chart", "left_anti").select(F.col("chart").alias("event_id"), _text("kinds").alias("told"))
    return errors.unionAll(warned)


@query("repaired_tokens", f"""WITH f(i, warnings, frames, notes, lane) AS (VALUES {_values([(i, *row[1:]) for i, row in enumerate(TOKENS)])})
  SELECT event_id, warnings, frames, notes, replace(lane, '%l', CAST(event_id % 8 + 1 AS VARCHAR)) AS lane FROM events JOIN f ON i = event_id % {len(TOKENS)}""")  # fmt: skip
def repaired_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Malformed token sequences: what was warned of, and what is left."""
    text = F.replace(_form([t for t, *_ in TOKENS]), F.lit("%a"), (F.col("event_id") % 8 + V.LANE_BASE).cast("string"))
    coded = table(spark, d, "events").select("event_id", F.filter(F.split(text, " "), lambda t: t != "").cast("array<int>").alias("tokens"))
    notes = F.flatten(F.transform("frames", lambda f: f["notes"]))
    lane = F.coalesce(F.get(notes, F.lit(0))["lane"].cast("string"), F.lit(""))
    return decode.tolerant(coded).select("event_id", F.array_join("warnings", ", ").alias("warnings"), F.size("frames").alias("frames"), F.size(notes).alias("notes"), lane.alias("lane"))


@query("placed_segments", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 40 * 0.5::DOUBLE + 0.5 AS last, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 * 1.0::DOUBLE END AS own FROM orders),
  p AS (SELECT *, coalesce(own, coalesce(sum(last) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS off FROM s)
  SELECT o_custkey, off + unnest([0.25, last]) AS time_sec FROM p""")  # fmt: skip
def placed_segments(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for segments of two frames; a third of them name their own offset."""
    key = F.col("o_orderkey")
    frame = lambda t: F.struct(t.alias("time_sec"), F.array().cast(f"array<{N.NOTE}>").alias("notes"))
    s = table(spark, d, "orders").select("o_custkey", key.alias("segment"), F.when(key % 3 == 0, key % 100 * 1.0).cast("double").alias("offset_sec"), F.array(frame(F.lit(0.25).cast("double")), frame((key % 40 * 0.5 + 0.5).cast("double"))).alias("frames"))
    return decode.placed(s, ("o_custkey",)).select("o_custkey", "time_sec")


_SHAPES = "[" + ", ".join(f"'{s}'" for s in V.SHAPES) + "]"


@query("frame_grammar", f"""WITH e AS (SELECT event_id, {_SHAPES}[event_id % 11 + 1] AS shape, event_id % 8 + 1 AS s, CAST(floor(value) AS BIGINT) % 8 + 1 AS t, CASE WHEN event_id % 5 > 0 AND (event_id % 11 = 3 OR event_id % 13 = 0) THEN event_id % 7 + 1 END AS m,
    event_id % 6 = 0 AS turned, event_id % 4 = 0 AND event_id % 3 = 0 AS still, event_id % 7 = 0 AS headless, (event_id // 8) % 8 + 1 AS tap, event_id % 9 = 0 AS more FROM events),
  x AS (SELECT *, (t - s + 8) % 8 AS step, tap % 8 + 1 AS other FROM e)
  SELECT event_id, CASE WHEN shape = 'Line' THEN step BETWEEN 2 AND 6 WHEN shape IN ('S', 'Z', 'Wifi') THEN step = 4 WHEN shape IN ('V', 'GrandV') THEN step > 0 ELSE true END
    AND CASE WHEN shape = 'GrandV' THEN m IS NOT NULL AND m <> s AND m <> t ELSE m IS NULL END AND (NOT turned OR shape = 'Circle') AND NOT still
    AND (headless OR (s <> tap AND NOT more)) AS valid FROM x""")  # fmt: skip
def frame_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a slide and one tap or two: spans of shapes, middle lanes, turns, presses, lanes used twice."""
    i = F.col("event_id")
    lane = lambda c: c.cast("int")
    segment = F.struct(
        _form(V.SHAPES), lane(i % 8 + 1), lane(F.floor("value") % 8 + 1), F.lit(0.0), F.when((i % 4 == 0) & (i % 3 == 0), 0.0).otherwise(0.5), F.when(i % 6 == 0, True),
        F.when((i % 5 > 0) & ((i % 11 == 3) | (i % 13 == 0)), lane(i % 7 + 1)), F.lit(False), F.lit(False), F.lit(False), i % 7 == 0,
    )
    null, no = F.lit(None), F.lit(False)
    slide = F.struct(F.lit("SLIDE"), null, null, null, null, F.array(segment), no, no).cast(N.NOTE)
    tap = lambda at: F.struct(F.lit("TAP"), lane(at), null, null, null, null, no, no).cast(N.NOTE)
    first = F.floor(i / 8) % 8 + 1
    notes = F.when(i % 9 == 0, F.array(slide, tap(first), tap(first % 8 + 1))).otherwise(F.array(slide, tap(first)))
    return table(spark, d, "events").select("event_id", notes.alias("notes")).select("event_id", N.frame_is_valid(F.col("notes")).alias("valid"))


@query("window_prefixes", f"""WITH {MEMBERS}, held AS (SELECT chart, k, flatten(list([3, {token_sql('rel_cs / 100.0')}] || body || [4] ORDER BY time_sec)) AS t FROM members WHERE part = 'prefix' GROUP BY chart, k),
  s AS (SELECT chart, k FROM (SELECT DISTINCT user_id AS chart FROM events), (SELECT unnest([0, 1, 50, 120, 259]) AS k)) SELECT chart, k, array_to_string([1] || coalesce(t, []), ' ') AS tokens FROM s LEFT JOIN held USING (chart, k)""")  # fmt: skip
def window_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """What a window starts with, from all frames of its chart."""
    songs = T.frames(spark, d).groupBy("chart").agg(F.array_sort(F.collect_list(F.struct("time_sec", "notes")), lambda a, b: F.when(a["time_sec"] < b["time_sec"], -1).otherwise(1)).alias("frames"))
    each = songs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 1, 50, 120, 259)])))
    start = windows.target_start(F.col("k"), TEN) - TEN.target_start
    return each.select("chart", "k", _text(windows.prefix_tokens(F.col("frames"), start, TEN)).alias("tokens"))


@query("windows_too_long", f"WITH {MEMBERS} SELECT chart, k, CAST(2 + sum(len(body) + 3) AS INTEGER) AS n FROM members GROUP BY chart, k HAVING 2 + sum(len(body) + 3) > 30")
def windows_too_long(spark: SparkSession, d: str) -> DataFrame:
    made = windows.index(T.frames(spark, d).select("chart", "time_sec", "notes"), T.songs(spark, d), TEN)
    return windows.too_long(made, 30).select("chart", "k", F.size("tokens").alias("n"))


@query("compile_statistics", f"""WITH {MEMBERS}, n AS (SELECT count(DISTINCT user_id) AS charts, count(DISTINCT CASE WHEN event_id % 50 = 0 THEN user_id END) AS bad FROM events), m AS (SELECT max(n) AS most FROM (SELECT 2 + sum(len(body) + 3) AS n FROM members GROUP BY chart, k))
  SELECT charts, charts * 260 AS windows, CAST(most AS INTEGER) AS max_tokens, bad AS parse_errors FROM n, m""")  # fmt: skip
def compile_statistics(spark: SparkSession, d: str) -> DataFrame:
    made = windows.index(T.frames(spark, d).select("chart", "time_sec", "notes"), T.songs(spark, d), TEN)
    return charts.statistics(made, table(spark, d, "events").where("event_id % 50 = 0").select(F.col("user_id").alias("chart")))


@query("overlap_commit", f"""WITH {MEMBERS}, c AS (SELECT chart, k, (k * 10.0::DOUBLE - 12) + rel_cs / 100.0::DOUBLE AS time_sec, rel_cs FROM members)
  SELECT chart, k, round(time_sec, 6) AS time_sec, row_number() OVER (PARTITION BY chart ORDER BY time_sec, k) AS place FROM c WHERE rel_cs >= 1200 AND rel_cs < 2200 AND time_sec >= k * 10.0::DOUBLE AND time_sec < (k + 1) * 10.0::DOUBLE""")  # fmt: skip
def overlap_commit(spark: SparkSession, d: str) -> DataFrame:
    """Every window's own frames come back as one time line."""
    held = windows.members(T.frames(spark, d).select("chart", "time_sec", "notes"), TEN)
    done = charts.overlap(held.select("chart", "k", (F.col("rel_cs") / 100.0).alias("time_sec"), "notes"), TEN)
    return done.select("chart", "k", F.round("time_sec", 6).alias("time_sec"), F.col("place").cast("long").alias("place"))


@query("decoding_stops", """WITH w AS (SELECT ['eos', 'token_budget', 'grammar_dead_end', 'pad', 'other'][l_orderkey % 5 + 1] AS r, CAST(l_quantity AS BIGINT) AS raw, CAST(l_quantity AS BIGINT) // 2 AS kept FROM lineitem)
  SELECT count(*) AS windows, count(*) FILTER (r = 'token_budget') AS "limit", count(*) FILTER (r = 'grammar_dead_end') AS dead_end, count(*) FILTER (r IN ('eos', 'pad')) AS ended, round(avg(raw), 9) AS raw_tokens, round(avg(kept), 9) AS kept_tokens, round(avg(raw - kept), 9) AS dropped_tokens FROM w""")
def decoding_stops(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    reason = F.get(F.array(*[F.lit(r) for r in ("eos", "token_budget", "grammar_dead_end", "pad", "other")]), (F.col("l_orderkey") % 5).cast("int"))
    told = metrics.decoding(table(spark, d, "lineitem").select(reason.alias("stop_reason"), q.alias("raw_new_tokens"), F.floor(q / 2).alias("new_tokens")))
    return told.select("windows", "limit", "dead_end", "ended", *[F.round(c, 9).alias(c) for c in ("raw_tokens", "kept_tokens", "dropped_tokens")])


@query("sampled_groups", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('42:' || user_id), user_id LIMIT 20) GROUP BY user_id")
def sampled_groups(spark: SparkSession, d: str) -> DataFrame:
    """All rows of twenty groups."""
    return split.sample_groups(table(spark, d, "events"), "user_id", 20).groupBy("user_id").agg(F.count("*").alias("n"))


@query("audio_slices", """WITH v AS (SELECT vec_id, embedding AS x, len(embedding) AS n, greatest(0, least(len(embedding), (vec_id % 19 - 2) * 4)) AS a, (vec_id % 19 - 2 + vec_id % 7) * 4 AS b FROM embeddings)
  SELECT vec_id, CAST(greatest(a, least(n, b)) - a AS INTEGER) AS n, round(coalesce(list_sum(list_transform(x[a + 1 : greatest(a, least(n, b))], lambda e: CAST(e AS DOUBLE))), 0), 6) AS total FROM v""")  # fmt: skip
def audio_slices(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stand for samples of 4 frames a second; times may lie outside of them."""
    begin = (F.col("vec_id") % 19 - 2).cast("double")
    v = table(spark, d, "embeddings").select("vec_id", augment.audio_slice(F.col("embedding"), begin, begin + F.col("vec_id") % 7, 4, 1).alias("x"))
    return v.select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, e: s + e), 6).alias("total"))


@query("whole_frames", f"WITH {NOTES}, c AS (SELECT event_id, (([3, 155] || body || [4]) || ([3, 255] || body || [4]))[1 : event_id % 20 + 1] AS t FROM notes) SELECT event_id, array_to_string(t[1 : coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i] = 4)), 0)], ' ') AS tokens FROM c")
def whole_frames(spark: SparkSession, d: str) -> DataFrame:
    """Two frames that a decoder may have left anywhere."""
    both = F.concat(N.frame_tokens(F.lit(1.5), F.array("note")), N.frame_tokens(F.lit(2.5), F.array("note")))
    cut = T.notes(spark, d).select("event_id", F.slice(both, F.lit(1), (F.col("event_id") % 20 + 1).cast("int")).alias("t"))
    return cut.select("event_id", _text(Q.up_to_last_frame(F.col("t"))).alias("tokens"))


@query("competing_matches", """WITH RECURSIVE o AS (SELECT o_custkey AS chart, o_orderkey * 37 % 60 * 4 AS t, o_orderkey * 53 % 60 * 4 AS p, o_orderkey % 3 > 0 AS made FROM orders),
  g AS (SELECT chart, list(t ORDER BY t) AS ts, coalesce(list(p ORDER BY p) FILTER (made), []) AS ps FROM o GROUP BY chart),
  s AS (SELECT chart, ts, ps, 0 AS i, CAST([] AS BIGINT[]) AS used FROM g
    UNION ALL SELECT chart, ts, ps, i + 1, CASE WHEN len(near) > 0 THEN list_append(used, -near[1].j) ELSE used END FROM (SELECT *, list_sort(list_transform(list_filter(range(1, len(ts) + 1), lambda j: NOT list_contains(used, j) AND abs(ts[j] - ps[i + 1]) <= 10), lambda j: {'d': abs(ts[j] - ps[i + 1]), 'j': -j})) AS near FROM s WHERE i < len(ps)))
  SELECT chart, CAST(len(used) AS BIGINT) AS tp, CAST(len(ps) AS BIGINT) AS n_predicted, CAST(len(ts) AS BIGINT) AS n_true FROM s WHERE i = len(ps)""")  # fmt: skip
def competing_matches(spark: SparkSession, d: str) -> DataFrame:
    """Events 4 ms apart or at once, of one key, so that several may match one another."""
    k = F.col("o_orderkey")
    side = lambda m, rows: rows.select(F.col("o_custkey").alias("chart"), (k * m % 60 * 4 / 1000.0).alias("time_sec"), F.lit("TAP").alias("key"))
    orders = table(spark, d, "orders")
    return matching.counts(side(53, orders.where(k % 3 > 0)), side(37, orders))


_MARK = lambda condition, token: f"CASE WHEN {condition} THEN [{token}] ELSE [] END"


@query("slide_tokens", f"""WITH e AS (SELECT event_id, event_id % 8 AS s, CAST(floor(value) AS BIGINT) % 8 AS t, event_id % 11 AS shape, event_id % 5 AS b, event_id % 7 AS x FROM events)
  SELECT event_id, array_to_string([3, 155, 3049] || {_MARK('b = 0', 3063)} || {_MARK('x = 0', 3064)} || [3050, 3052 + shape, 3005 + s, 3005 + t] || {_MARK('shape = 3', '3005 + event_id % 7')} || [5 + event_id % 3 * 50, {token_sql('event_id % 4000 / 100.0')}]
    || CASE event_id % 3 WHEN 0 THEN [3066] WHEN 1 THEN [3067] ELSE [] END || {_MARK('b = 1', 3068)} || {_MARK('b = 2', 3069)} || {_MARK('b = 3', 3070)} || {_MARK('x = 1', 3071)} || [3051]
    || [3050, 3052, 3005 + t, 3005 + s, 5, 6] || {_MARK('b = 3', 3070)} || [3051, 4], ' ') AS tokens, true AS same FROM e""")  # fmt: skip
def slide_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Slides of two segments in tokens, and whether the notes that these are read as have the same tokens again. Marks of
    the head stand in the first segment only."""
    i = F.col("event_id")
    lane, null, no = (lambda c: c.cast("int")), F.lit(None), F.lit(False)
    start, end = lane(i % 8 + 1), lane(F.floor("value") % 8 + 1)
    star, rotate, broken, headless = i % 5 == 1, i % 5 == 2, i % 5 == 3, i % 7 == 1
    turn = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    first = F.struct(_form(V.SHAPES), start, end, i % 3 * 0.5, i % 4000 / 100.0, turn, F.when(i % 11 == 3, lane(i % 7 + 1)), star, rotate, broken, headless).cast(N.SEGMENT)
    second = F.struct(F.lit("Line"), end, start, F.lit(0.0), F.lit(0.01), null, null, star, rotate, broken, headless).cast(N.SEGMENT)
    note = F.struct(F.lit("SLIDE"), null, null, null, null, F.array(first, second), i % 5 == 0, i % 7 == 0).cast(N.NOTE)
    coded = table(spark, d, "events").select("event_id", F.array(note).alias("notes")).select("event_id", N.frame_tokens(F.lit(1.5), F.col("notes")).alias("tokens"))
    frame = F.get("frames", F.lit(0))
    read = decode.tolerant(coded.withColumn("held", F.col("tokens"))).where("size(warnings) = 0")
    return read.select("event_id", _text("held").alias("tokens"), (N.frame_tokens(frame["time_sec"], frame["notes"]) == F.col("held")).alias("same"))


@query("chart_headers", """SELECT c_custkey AS chart, 'song ' || c_custkey % 7 AS title, CASE WHEN c_custkey % 2 = 0 THEN 'someone' ELSE '' END AS artist, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS short_id,
    '2:7 ' || CASE WHEN c_custkey % 5 = 0 THEN '5:14' ELSE '5:13+' END AS levels, CASE WHEN c_custkey % 4 = 0 THEN 'level_3 level_6' ELSE 'level_6' END AS bodies FROM customer""")  # fmt: skip
def chart_headers(spark: SparkSession, d: str) -> DataFrame:
    """Titles, artists, ids, levels by name (the last of repeated ones), and the levels that have a body."""
    k = F.col("c_custkey")
    text = F.concat(
        F.format_string("&title= song %d \n", k % 7), F.when(k % 2 == 0, "&artist=someone\n").otherwise(""), F.when(k % 3 == 0, F.format_string("&shortid=%d \n", k)).otherwise("&shortid=x1\n"), F.lit("&lv_2=7\n&lv_5=13+\n"),
        F.when(k % 5 == 0, "&lv_5= 14\n").otherwise(""), F.lit("&inote_5=1,E\n"), F.when(k % 4 == 0, "&inote_2=\n").otherwise(""), F.lit("&des=x"),
    )
    p = parse.parse(table(spark, d, "customer").select(k.alias("chart"), text.alias("text")))
    named = F.array_join(F.transform(F.array_sort(F.map_entries("local_levels")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    bodies = p.levels.groupBy("chart").agg(_text(F.array_sort(F.collect_list("level_name"))).alias("bodies"))
    return p.charts.join(bodies, "chart").select("chart", "title", "artist", "short_id", named.alias("levels"), "bodies")


@query("ended_sequences", f"""WITH {NOTES}, c AS (SELECT event_id, [1] || CASE WHEN event_id % 2 = 0 THEN [3, 55] || body || [4] ELSE [] END AS given, ([3, 155] || body || [4] || [3, 255] || body || [4])[1 : event_id % 20] AS made, event_id % 8 // 2 AS r FROM notes),
  t AS (SELECT event_id, len(given) AS g, given || made || CASE WHEN r < 2 THEN [] ELSE [2] END AS t, r < 2 AS broken FROM c), u AS (SELECT *, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i] = 4)) AS last FROM t)
  SELECT event_id, array_to_string(CASE WHEN broken THEN t[1 : coalesce(last, g)] || [2] ELSE t END, ' ') AS tokens, len(t) - g AS raw, CASE WHEN broken THEN coalesce(last, g) + 1 ELSE len(t) END - g AS kept, CASE WHEN broken THEN len(t) - coalesce(last, g) ELSE 0 END AS dropped FROM u""")  # fmt: skip
def ended_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Decoding that stopped anywhere, for each of the four reasons, behind a prefix of no frame or of one."""
    i = F.col("event_id")
    frame = lambda t: N.frame_tokens(F.lit(t), F.array("note"))
    given = F.concat(F.array(F.lit(V.SOS)), F.when(i % 2 == 0, frame(0.5)).otherwise(F.array().cast("array<int>")))
    r = F.floor(i % 8 / 2).cast("int")
    reason = F.get(F.array(*[F.lit(x) for x in ("token_budget", "grammar_dead_end", "eos", "pad")]), r)
    made = F.slice(F.concat(frame(1.5), frame(2.5)), F.lit(1), (i % 20).cast("int"))
    end = F.when(r < 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(V.EOS)))
    c = T.notes(spark, d).select("event_id", F.size(given).alias("g"), F.concat(given, made, end).alias("t"), reason.alias("reason"))
    e = c.select("event_id", Q.ended(F.col("t"), F.col("g"), F.col("reason")).alias("e")).select("event_id", "e.*")
    long = lambda c, n: F.col(c).cast("long").alias(n)
    return e.select("event_id", _text("tokens").alias("tokens"), long("raw_new_tokens", "raw"), long("new_tokens", "kept"), long("dropped_tokens", "dropped"))
