"""The driver's event stream as charts: a user is a chart, an event a note, and a second of song 1000 seconds of the stream.

`NOTES` is the same in SQL, with each note's tokens worked out directly from the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrolith.functions import notes as N
from metrolith.functions import vocabulary as V
from metrolith.operators.windows import Windows

#: Microseconds at the start of the stream, and of the stream in a second of song.
START_US, SECOND_US = 1_704_067_200_000_000, 1e9
#: Feature frames of a song: thirty days at that pace.
SONG_FRAMES = 194_400
#: A window for every ten seconds.
TEN = Windows(stride=10.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chart, time_sec, note."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    i, kind, length = F.col("event_id"), F.col("event_type"), F.col("value") / 100.0
    lane, area = (i % 8 + 1).cast("int"), F.element_at(F.array(*[F.lit(a) for a in V.AREAS]), (i % 33 + 1).cast("int"))
    touch, slide = kind.isin("purchase", "signup"), kind == "error"
    no = F.lit(False)
    segment = F.struct(
        F.lit("Line").alias("shape"), lane.alias("start_lane"), ((i + 3) % 8 + 1).cast("int").alias("end_lane"), F.lit(0.5).alias("wait_sec"), length.alias("trace_sec"), F.lit(None).cast("boolean").alias("cw"),
        F.lit(None).cast("int").alias("middle_lane"), no.alias("force_star"), no.alias("fake_rotate"), (i % 3 == 0).alias("slide_break"), (i % 4 == 0).alias("no_head"),
    )
    name = F.when(kind == "click", "TAP").when(kind == "view", "HOLD").when(kind == "purchase", "TOUCH").when(kind == "signup", "TOUCH_HOLD").otherwise("SLIDE")
    note = F.struct(
        name.alias("type"), F.when(~touch & ~slide, lane).alias("lane"), F.when(touch, area).alias("area"), F.when(kind.isin("view", "signup"), length).alias("hold_sec"), F.when(touch, i % 2 == 0).alias("firework"),
        F.when(slide, F.array(segment)).alias("segments"), (~touch & (i % 3 == 0)).alias("is_break"), (~touch & (i % 5 == 0)).alias("is_ex"),
    ).cast(N.NOTE)
    time = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(START_US)) / F.lit(SECOND_US)
    return e.select("event_id", F.col("user_id").alias("chart"), time.alias("time_sec"), note.alias("note"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chart, level, time_sec, notes: notes of one instant in the order of event_id."""
    held = notes(spark, sf_dir).groupBy("chart", "time_sec").agg(F.collect_list(F.struct("event_id", "note")).alias("all"))
    by_id = lambda a, b: F.when(a["event_id"] < b["event_id"], -1).otherwise(1)
    return held.select("chart", F.lit(5).alias("level"), "time_sec", F.transform(F.array_sort("all", by_id), lambda s: s["note"]).alias("notes"))


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chart")).distinct().withColumn("feature_frames", F.lit(SONG_FRAMES).cast("long"))


def _token(seconds: str) -> str:
    raw = f"CASE WHEN {seconds} > 0 AND round_even({seconds} * 100, 0) = 0 THEN 1 ELSE round_even({seconds} * 100, 0) END"
    return f"CAST(5 + greatest(0, least(2999, {raw})) AS INTEGER)"


def _mark(condition: str, token: int) -> str:
    return f"CASE WHEN {condition} THEN [{token}] ELSE [] END"


_ends = " || ".join((_mark("event_id % 3 = 0", 3063), _mark("event_id % 5 = 0", 3064)))
#: event_id, chart, time_sec, kind, body (the note's tokens).
NOTES = f"""
notes AS (
  SELECT event_id, user_id AS chart, (epoch_us(ts) - {START_US}) / {SECOND_US} AS time_sec, event_type AS kind, value, CASE event_type
    WHEN 'click' THEN [3046, CAST(3005 + event_id % 8 AS INTEGER)] || {_ends}
    WHEN 'view' THEN [3048, CAST(3005 + event_id % 8 AS INTEGER), {_token("value / 100.0")}] || {_ends}
    WHEN 'purchase' THEN [3047, CAST(3013 + event_id % 33 AS INTEGER)] || {_mark("event_id % 2 = 0", 3065)}
    WHEN 'signup' THEN [3047, CAST(3013 + event_id % 33 AS INTEGER), {_token("value / 100.0")}] || {_mark("event_id % 2 = 0", 3065)}
    ELSE [3049] || {_ends} || [3050, 3052, CAST(3005 + event_id % 8 AS INTEGER), CAST(3005 + (event_id + 3) % 8 AS INTEGER), 55, {_token("value / 100.0")}] || {_mark("event_id % 3 = 0", 3070)} || {_mark("event_id % 4 = 0", 3071)} || [3051]
  END AS body FROM events
)"""
#: chart, time_sec, body: the notes of one instant in a row.
FRAMES = NOTES + ", frames AS (SELECT chart, time_sec, flatten(list(body ORDER BY event_id)) AS body FROM notes GROUP BY chart, time_sec)"
#: chart, cs, what, spot, until_cs of each lane and area that is used.
USES = NOTES + """, uses AS (
  SELECT chart, CAST(round_even(time_sec * 100, 0) AS BIGINT) AS cs, CASE WHEN kind IN ('purchase', 'signup') THEN 'touch' ELSE 'press' END AS what,
    CASE WHEN kind IN ('purchase', 'signup') THEN 33 + event_id % 33 ELSE event_id % 8 END AS spot,
    CASE WHEN kind IN ('view', 'signup') THEN CAST(round_even(time_sec * 100, 0) + round_even(value / 100.0 * 100, 0) AS BIGINT) END AS until_cs
  FROM notes WHERE NOT (kind = 'error' AND event_id % 4 = 0)
)"""


def crowded_sql(release: int, gap: int) -> str:
    return f"""{USES}, crowded AS (SELECT * FROM (
    SELECT *, max(until_cs) OVER earlier AS taken, max(cs) OVER earlier AS last_cs, count(*) OVER (PARTITION BY chart, what, spot, cs) AS many
    FROM uses WINDOW earlier AS (PARTITION BY chart, what, spot ORDER BY cs RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) WHERE cs <= taken + {release} OR (what = 'press' AND cs - last_cs < {gap}) OR many > 1)"""


token_sql = _token
#: chart, time_sec, body, k, rel_cs, part: the frames that each window of TEN holds.
MEMBERS = f"""{FRAMES}, near AS (SELECT chart, time_sec, body, unnest(generate_series(CAST(greatest(0, floor((time_sec - 10.01) / 10)) AS BIGINT), CAST(floor((time_sec + 6.01) / 10) AS BIGINT))) AS k FROM frames),
  placed AS (SELECT *, CAST(round_even((time_sec - (k * 10.0::DOUBLE - 12)) * 100, 0) AS BIGINT) AS rel_cs FROM near),
  members AS (SELECT *, CASE WHEN rel_cs < 1200 THEN 'prefix' ELSE 'target' END AS part FROM placed WHERE rel_cs >= 600 AND rel_cs < 2200)"""
