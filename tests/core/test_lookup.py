"""The lookup by title and levels against a plain reading of its rule, and on a title that very many charts and songs have."""

import random
import time

from metrolith.operators import lookup
from metrolith.sources import charts as S
from pyspark.sql import functions as F

CHARTS = "chart long, title string, short_id string, local_levels map<int,string>"


def plain(chart, songs):
    _, title, short, local = chart
    own = sorted((s for s in songs if short is not None and s[0] == short), key=lambda s: s[1])
    if own:
        return own[0][0]
    loose = {"13": "13", "13.0": "13", "13.5": "13+"}
    for name in (lambda n: n, lambda n: loose.get(n, n)):
        fits = []
        for s in songs:
            both = [k for k in local or {} if 2 <= k < 2 + len(s[2])]
            if title == s[1] and both and all(local[k] is not None and s[2][k - 2] == name(local[k]) for k in both):
                fits.append(s[0])
        if len(fits) == 1:
            return fits[0]
    return None


def test_lookup_is_its_rule(spark):
    draw = random.Random(5)
    names = ["13", "13+", "13.5", "13.0", "7", None]
    songs = [(str(i), f"t{draw.randrange(6)}", [draw.choice(names) for _ in range(draw.randrange(4))], [1.0], ("pop",)) for i in range(40)]
    given = [(i, draw.choice(["t0", "t1", "t2", "t3", "t9", None]), draw.choice([None, None, str(draw.randrange(50))]), draw.choice([None, {k: draw.choice(names) for k in draw.sample(range(1, 7), draw.randrange(4))}])) for i in range(400)]
    got = dict(lookup.match(spark.createDataFrame(given, CHARTS), spark.createDataFrame(songs, S.CATALOGUE)).select("chart", "song_id").collect())
    assert got == {c[0]: plain(c, songs) for c in given}
    assert len(set(got.values())) > 10


def test_many_charts_and_songs_of_one_title(spark):
    """Pair by pair these are 800 million."""
    level = lambda n: (F.col("id") % n).cast("string")
    songs = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.array(level(20_000), F.lit("13+")).alias("level"), F.array(F.lit(1.0)).alias("ds"), F.struct(F.lit("pop").alias("genre")).alias("basic_info"))
    given = spark.range(40_000).select(F.col("id").alias("chart"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("short_id"), F.create_map(F.lit(2), level(40_000), F.lit(3), F.lit("13.5")).alias("local_levels"))
    start = time.monotonic()
    found = lookup.match(given, songs).agg(F.count("*").alias("n"), F.count("song_id").alias("met"), F.count_if(F.col("song_id") == F.col("chart").cast("string")).alias("own")).first()
    assert (found["n"], found["met"], found["own"]) == (40_000, 20_000, 20_000)
    assert time.monotonic() - start < 60
