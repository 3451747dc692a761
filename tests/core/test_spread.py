"""Scans along hot keys, the chart store, feature files, batches, draws and checks of whole batches, against plain versions."""

import hashlib
import json
import random
from dataclasses import replace

import numpy as np
import pytest
from metrolith import __main__ as commands
from metrolith import config
from metrolith.functions import vocabulary as V
from metrolith.operators import augment, constraints, decode, matching, parse, render, scan, segments, windows
from metrolith.plans import charts
from metrolith.plans import tables as T
from metrolith.sources import charts as S
from metrolith.sources import features, store
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def plain_carry(rows, inclusive):
    """rows: key, at, value; in order the newest value and the sum of those before."""
    out = {}
    for key in {r[0] for r in rows}:
        newest, total = None, 0
        for _, at, value in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if inclusive:
                newest, total = (newest if value is None else value), total + (value or 0)
            out[key, at] = newest, total
            if not inclusive:
                newest, total = (newest if value is None else value), total + (value or 0)
    return out


@pytest.mark.parametrize("span", [None, 7])
def test_scan_of_the_greatest(spark, span):
    draw = random.Random(5)
    rows = [(key, at, draw.choice([None, draw.randrange(1000)])) for key in ("hot", "b") for at in range(150 if key == "hot" else 4)]
    df = spark.createDataFrame(rows, "key string, at long, value long")
    for inclusive in (True, False):
        got = {(r.key, r.at): r.most for r in scan.carry(df, ("key",), "at", span, most={"most": F.col("value")}, inclusive=inclusive).collect()}
        for key, at, _ in rows:
            assert got[key, at] == max((v for k, a, v in rows if k == key and v is not None and (a < at or inclusive and a == at)), default=None)


def test_rejection_is_the_same_either_way(spark):
    frames = T.frames(spark, DIR)
    crowd = frames.withColumn("time_sec", F.round(F.col("time_sec") / 40, 2)).groupBy("chart", "time_sec").agg(F.first("level").alias("level"), F.flatten(F.collect_list("notes")).alias("notes"))
    for some in (frames, crowd, crowd.where("chart % 5 = 0").unionAll(crowd.limit(1).select(F.lit(999).alias("chart"), "time_sec", "level", F.expr("filter(notes, n -> false)")))):
        listed = constraints.violations(some, ("chart",))
        assert {r.chart for r in constraints.conflicts(some, ("chart",)).collect()} == {r.chart for r in constraints.conflicts(some, ("chart",), span=300).collect()} == {r.chart for r in listed.collect()}
        spread = constraints.violations(some, ("chart",), span=5.0)
        assert listed.exceptAll(spread).count() == spread.exceptAll(listed).count() == 0 < listed.count()


def test_commits_are_numbered_the_same_either_way(spark):
    made = spark.range(600).select((F.col("id") % 2).alias("chart"), F.floor(F.col("id") / 20).alias("k"), (12 + F.col("id") % 20 / 2.0).alias("time_sec"), F.array(F.lit(1)).alias("notes"))
    plain = charts.overlap(made)
    assert plain.exceptAll(charts.overlap(made, span=4)).count() == 0 < plain.count()


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("span", [None, 1, 7, 1000])
def test_scan(spark, span, inclusive):
    draw = random.Random(3)
    rows = [(key, at, draw.choice([None, None, draw.randrange(100)])) for key in ("hot", "b", None) for at in draw.sample(range(-50, 300), 150 if key == "hot" else 9)]
    df = spark.createDataFrame(rows, "key string, at long, value long")
    out = scan.carry(df, ("key",), "at", span, last={"newest": F.col("value")}, total={"total": F.col("value")}, inclusive=inclusive)
    assert out.columns == ["key", "at", "value", "newest", "total"]
    assert {(r.key, r.at): (r.newest, r.total) for r in out.collect()} == plain_carry(rows, inclusive)
    assert scan.carry(df.where("false"), ("key",), "at", span, total={"total": F.col("value")}).count() == 0


def test_a_hot_key_is_dealt_to_tasks(spark):
    """One key with all rows: no range holds a tenth of them, and the result is that of one window."""
    df = spark.range(20_000).select(F.lit(1).alias("key"), F.col("id").alias("at"), (F.col("id") % 7).alias("value"))
    out = scan.carry(df, ("key",), "at", 1000, total={"total": F.col("value")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(key" in plan and "__range" in plan
    assert out.where("at = 19999").first()["total"] == sum(i % 7 for i in range(19_999))
    per_range = df.groupBy(F.floor(F.col("at") / 1000)).count().agg(F.max("count")).first()[0]
    assert per_range * 10 <= 20_000


def fold(rows, longest):
    """(time, offset) by the sequential rule; rows: time, until."""
    out, offset, end = [], 0.0, None
    for time, until in sorted(rows):
        reach = until if end is None else max(end, until)
        if end is not None and reach - offset > longest:
            offset, reach = time, until
        end = reach
        out.append((time, offset))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segment_starts_by_pointers(spark, seed):
    draw = random.Random(seed)
    rows = []
    for chart in range(5):
        at = 0.0
        for _ in range(draw.choice([1, 3, 400])):
            at += draw.choice([0.0, 0.1, 0.5, 3.0]) + draw.random() / 10 + (45 if draw.random() < 0.01 * seed else 0)
            rows.append((chart, at, at + draw.choice([0, 0, 0, draw.random() * 40])))
    df = spark.createDataFrame(rows, "chart long, time_sec double, until double")
    out = segments.offsets(df, ("chart",), 30.0, 60.0).collect()
    for chart in range(5):
        assert sorted((r.time_sec, r.offset_sec) for r in out if r.chart == chart) == fold([r[1:] for r in rows if r[0] == chart], 30.0)


def test_segments_of_one_long_key(spark):
    """Two hundred thousand frames of one key without a gap."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("chart"), (F.col("id") / 10).alias("time_sec"), (F.col("id") / 10 + F.when(F.col("id") % 17 == 0, F.col("id") % 9 + 3).otherwise(0)).alias("until"))
    out = {r.time_sec: r.offset_sec for r in segments.offsets(df, ("chart",), 30.0, 1000.0).collect()}
    assert out == dict(fold([(i / 10, i / 10 + (i % 9 + 3 if i % 17 == 0 else 0)) for i in range(n)], 30.0))
    with pytest.raises(ValueError):
        segments.offsets(df, ("chart",), 30.0, 59.0)


def test_segments_are_the_same_either_way(spark):
    frames = T.frames(spark, DIR)
    plain, spread = segments.cut(frames, ("chart",)), segments.cut(frames, ("chart",), span=100.0)
    assert plain.exceptAll(spread).count() == spread.exceptAll(plain).count() == 0 < plain.count()


def test_matches_are_the_same_either_way(spark):
    draw = random.Random(8)
    side = lambda n: spark.createDataFrame([(1, draw.randrange(3000) / 1000, "TAP") for _ in range(n)] + [(2, None, "TAP")], "chart long, time_sec double, key string")
    predicted, truth = side(700), side(800)
    plain = matching.counts(predicted, truth).collect()
    assert sorted(plain) == sorted(matching.counts(predicted, truth, span=0.5).collect())
    assert {(r.chart, r.n_predicted, r.n_true) for r in plain} == {(1, 700, 800), (2, 1, 1)} and next(r.tp for r in plain if r.chart == 2) == 0
    p, t = (sorted(r.time_sec for r in s.where("chart = 1").collect()) for s in (predicted, truth))
    assert next(r.tp for r in plain if r.chart == 1) == matching.greedy(p, t, 0.01)


def test_segments_are_placed_the_same_either_way(spark):
    frames = F.array(F.struct((F.col("id") % 5).cast("double").alias("time_sec"), F.array(F.lit(1)).alias("notes")))
    told = spark.range(400).select((F.col("id") % 2).alias("chart"), F.floor(F.col("id") / 2).alias("segment"), F.when(F.col("id") % 11 == 0, 7.5).alias("offset_sec"), frames.alias("frames"))
    plain = decode.placed(told, ("chart",))
    assert plain.exceptAll(decode.placed(told, ("chart",), 10)).count() == 0 < plain.count()


def test_lines_are_the_text(spark, tmp_path):
    """Charts as lines in files, by ranges, are the charts in one string; and what is read from both is the same."""
    frames = T.frames(spark, DIR).where("chart < 8")
    levels = frames.select("chart", "level").distinct().withColumn("level_query", F.lit(13.5)).unionByName(spark.createDataFrame([(99, 2, 1.0)], "chart long, level int, level_query double"))
    heads = levels.select("chart", F.concat(F.lit("song "), "chart").alias("title"), F.lit(None).cast("string").alias("artist")).distinct()
    whole = {str(r.chart): r.text for r in render.charts(heads, levels, frames).collect()}
    for span in (None, 50.0):
        lines = render.chart_lines(heads, levels, frames, span)
        render.write_lines(lines, str(tmp_path / str(span)), 7)
        for chart, text in whole.items():
            files = sorted((tmp_path / str(span) / f"chart={chart}").glob("part-*"))
            assert "".join(f.read_text() for f in files) == text + "\n"
    numbered = render.numbered_lines(lines)
    assert {str(r.chart): r.text for r in numbered.groupBy("chart").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line", "text"))).text, "\n").alias("text")).collect()} == whole
    a = parse.clock(parse.slots(parse.levels(spark.createDataFrame(list(whole.items()), "chart string, text string"))))
    b = parse.clock(parse.line_slots(numbered, 20), 20).withColumn("chart", F.col("chart").cast("string"))
    shown = lambda df: sorted((r.chart, r.level, r.slot, r.raw, round(r.time_sec, 6)) for r in df.where("raw <> ''").collect())
    assert shown(a) == shown(b) and len(shown(a)) > 20


def test_a_note_that_cant_be_written_leaves_its_chart_out(spark):
    frames = T.frames(spark, DIR).where("chart < 4")
    broken = frames.withColumn("notes", F.when(F.col("chart") == 2, F.transform("notes", lambda n: n.withField("type", F.lit("NOTHING")))).otherwise(F.col("notes")))
    levels = frames.select("chart", "level").distinct().withColumn("level_query", F.lit(1.0))
    heads = levels.select("chart", F.lit("a").alias("title"), F.lit("b").alias("artist"))
    assert {r.chart for r in render.chart_lines(heads, levels, broken).collect()} == {r.chart for r in levels.collect()} - {2}


# The store


def sources(spark, marks):
    return spark.createDataFrame([(f"c{i}", m, 100 + i) for i, m in marks.items()], "chart string, modified long, size long")


def test_only_what_changed_is_built(spark, tmp_path):
    held, built = store.Store(spark, str(tmp_path / "s"), 8), []

    def build(todo):
        built.append(sorted(r.chart for r in todo.collect()))
        return {"windows": todo.select("chart", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "modified"), "errors": todo.where("modified = 5").select("chart")}

    marks = dict.fromkeys(range(100), 1)
    first = held.update(sources(spark, marks), build)
    assert len(built[0]) == 100 and held.update(sources(spark, marks), build) is None and len(built) == 1
    marks[17] = 5
    second = held.update(sources(spark, marks), build)
    assert built[1:] == [["c17"]] and second != first
    rows = held.read("windows").collect()
    assert len(rows) == 200 and {(r.chart, r.modified) for r in rows} == {(f"c{i}", m) for i, m in marks.items()}
    assert [r.chart for r in held.read("errors").collect()] == ["c17"]
    del marks[3]
    marks[200] = 1
    held.update(sources(spark, marks), build)
    assert built[-1] == ["c200"] and {r.chart for r in held.read("windows").collect()} == {f"c{i}" for i in marks}
    before = sorted(map(tuple, held.read("windows").select("chart", "k", "modified").collect()))
    whole = held.compact(["windows", "errors"])
    assert [g["generation"] for g in held.generations()] == [whole]
    assert sorted(map(tuple, held.read("windows").select("chart", "k", "modified").collect())) == before
    assert held.update(sources(spark, marks), build) is None
    marks[17] = 6
    held.update(sources(spark, marks), build)
    assert built[-1] == ["c17"] and held.read("errors").count() == 0


def test_a_lost_build_changes_nothing(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"), 4)
    give = lambda todo: {"windows": todo.select("chart", "modified")}
    held.update(sources(spark, {1: 1, 2: 1}), give)

    def fails(todo):
        return {"windows": todo.select("chart", "modified"), "other": todo.select("chart", F.raise_error(F.lit("lost")).alias("x"))}

    with pytest.raises(Exception, match="lost"):
        held.update(sources(spark, {1: 2, 2: 1}), fails)
    assert {(r.chart, r.modified) for r in held.read("windows").collect()} == {("c1", 1), ("c2", 1)}
    held.update(sources(spark, {1: 2, 2: 1}), give)
    assert {(r.chart, r.modified) for r in held.read("windows").collect()} == {("c1", 2), ("c2", 1)}


def test_reading_some_charts_opens_some_files(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"), 32)
    held.update(sources(spark, dict.fromkeys(range(300), 1)), lambda todo: {"windows": todo.select("chart", "size")})
    some = held.read("windows", ["c5", "c7"])
    assert sorted(r.chart for r in some.collect()) == ["c5", "c7"]
    scans = [x.split("]")[0] for x in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]]
    assert scans and all("bucket" in x and "generation" in x for x in scans)
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    read = spark.read.parquet(f"{held.root}/windows")
    wanted = [r[0] for r in some.select("bucket").distinct().collect()]
    assert files(read.where(F.col("bucket").isin(wanted))) <= 2 < 20 < files(read)
    by_table = held.read("windows", spark.createDataFrame([("c5",), ("c7",), ("nowhere",)], "chart string"))
    assert sorted(r.chart for r in by_table.collect()) == ["c5", "c7"]
    assert held.read("windows", ["nowhere"]).count() == 0


def test_settings_are_checked_when_a_store_is_read(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"), 2)
    with pytest.raises(ValueError, match="nothing was built"):
        held.read("windows")
    made = config.Config()
    held.update(sources(spark, {1: 1}), lambda todo: {"windows": todo.select("chart")}, made)
    other = replace(made, window=replace(made.window, prefix_start_sec=5.0), training=replace(made.training, seed=7))
    assert held.read("windows", settings=replace(made, training=replace(made.training, seed=7))).count() == 1
    with pytest.raises(ValueError, match="window.prefix_start_sec"):
        held.read("windows", settings=other)


# Feature files, batches, draws, rotations, audit


def test_windows_from_feature_files(spark, tmp_path):
    draw, root = np.random.default_rng(2), tmp_path / "features"
    root.mkdir()
    songs = {"a.npy": draw.normal(size=(40, 3)).astype(np.float16), "b.npy": draw.normal(size=(5, 3)).astype(np.float32), "c.npy": np.zeros((0, 3), np.float32)}
    for name, x in songs.items():
        np.save(root / name, x)
    w = windows.Windows(features=8, hz=1)
    starts = [(name, k, float(s)) for name in songs for k, s in enumerate((-9, -2, 0, 3, 36, 50))]
    given = spark.createDataFrame(starts, "feature string, k long, start double")
    frames = F.element_at(F.create_map(*[F.lit(v) for name, x in songs.items() for v in (name, len(x))]), F.col("feature"))
    asked = given.withColumns(windows.feature_range(F.col("start"), frames, w))
    out = {(r.feature, r.k): r for r in features.window_features(asked, str(root), str(tmp_path / "windows"), w, 2).collect()}
    assert len(out) == len(starts)
    for name, k, start in starts:
        x, begin = songs[name].astype(np.float32), int(start)
        expected = np.zeros((8, 3), np.float32)
        there = [i for i in range(8) if 0 <= begin + i < len(x)]
        for i in there:
            expected[i] = x[begin + i]
        row = out[name, k]
        assert row["mask"] == [i in there for i in range(8)], (name, k)
        assert len(row.features) == 8 and all(np.allclose(f or [0, 0, 0], e) for f, e in zip(row.features, expected, strict=True)), (name, k)


def test_feature_files_of_the_wrong_form_are_refused(tmp_path):
    import pyarrow as pa

    for name, x in (("one.npy", np.zeros(3)), ("order.npy", np.asfortranarray(np.zeros((2, 3))))):
        np.save(tmp_path / name, x)
        with pa.OSFile(str(tmp_path / name)) as file, pytest.raises(ValueError):
            features.header(file)
    (tmp_path / "no.npy").write_bytes(b"something else")
    with pa.OSFile(str(tmp_path / "no.npy")) as file, pytest.raises(ValueError):
        features.header(file)


def test_batches_are_padded_and_never_cut(spark):
    rows = [(i, [1, *range(10, 10 + i % 4), 2], 1 + i % 2, i * 1.5) for i in range(10)]
    df = spark.createDataFrame(rows, "i long, tokens array<int>, loss_start int, window_start double")
    out = sorted(windows.collate(df, 4, 6, "i", ("window_start",)).collect(), key=lambda r: r.batch)
    assert [len(r.tokens) for r in out] == [4, 4, 2]
    for i, tokens, begin, start in rows:
        r, place = out[i // 4], i % 4
        n = len(tokens)
        assert r.tokens[place] == tokens + [0] * (6 - n) and r["mask"][place] == [k < n for k in range(6)]
        assert r.loss_mask[place] == [begin <= k < n for k in range(6)] and r.window_start[place] == start
    with pytest.raises(Exception, match="doesn't fit 4"):
        windows.collate(df, 4, 4, "i").collect()


def test_draws_follow_from_md5(spark):
    got = spark.range(5).select("id", augment.drawn(42, F.col("id"), F.lit("run")).alias("u")).collect()
    for r in got:
        assert r.u == (int(hashlib.md5(f"42:{r.id}:run".encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def test_rotation_check(spark, tmp_path, capsys):
    good = [V.SOS, V.FRAME_START, V.TS_BASE + 3, V.NOTE_TAP, V.LANE_BASE + 2, V.FRAME_END, V.FRAME_START, V.TS_BASE + 9, V.NOTE_TOUCH, V.TOUCH_BASE + 16, V.FRAME_END, V.EOS]
    rows = spark.createDataFrame([(good + [V.PAD],)], "tokens array<int>")
    assert augment.unsound_rotations(rows).count() == 0
    bad = spark.createDataFrame([(good[:-1],), ([V.SOS, V.FRAME_START, V.FRAME_START, V.EOS],)], "tokens array<int>")
    reasons = {r.reason for r in augment.unsound_rotations(bad).collect()}
    assert "a mark at an end is lost" in reasons and len(reasons) > 1
    rows.write.parquet(str(tmp_path / "windows"))
    commands.rotation(spark, commands.arguments().parse_args(["rotation", "--windows", str(tmp_path / "windows")]))
    assert "as it should be" in capsys.readouterr().out
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(SystemExit):
        commands.rotation(spark, commands.arguments().parse_args(["rotation", "--windows", str(tmp_path / "bad"), "--limit", "5"]))


def test_audit_of_a_batch(spark):
    head = "&title=t\n&lv_5=13\n&inote_5=\n"
    texts = [("a", head + "(120){4}1h[4:1],,2h[2:1],E"), ("b", head + "(60){4}3h[4:1],4,E"), ("c", head + "(60){4}9,E"), ("d", None), ("e", head + "(113){7}1,2,3,4,5,6,E")]
    told = {(r.kind, r.name): (r.n, r.low, r.high) for r in charts.batch_audit(spark.createDataFrame(texts, "chart string, text string")).collect()}
    assert told["charts", "parsed"][0] == 4 and told["charts", "errors"][0] == 1
    assert told["extreme", "hold"] == (2, 0.5, 1.0) and told["extreme", "frame_gap_ms"][0] == 3
    expected = charts.round_trip(spark.createDataFrame(texts, "chart string, text string")).where("not same").count()
    assert told["charts", "changed"][0] == expected


def test_the_index_is_brought_up_to_date(spark, tmp_path):
    songs, made, out = tmp_path / "songs", tmp_path / "features", tmp_path / "out"
    made.mkdir()
    for i in range(4):
        folder = songs / f"s{i}"
        folder.mkdir(parents=True)
        (folder / "maidata.txt").write_text(f"&title=t{i}\n&lv_5=13\n&inote_5=\n(120){{4}}1,2,3,E")
        (folder / "track.mp3").write_bytes(b"x")
        np.save(made / f"{hashlib.md5(f's{i}/maidata.txt'.encode()).hexdigest()}.npy", np.zeros((300, 768), np.float16))
    args = commands.arguments().parse_args(["index", "--charts", str(songs), "--features", str(made), "--out", str(out), "--stride", "2"])
    root = commands.index(spark, args)
    held = store.Store(spark, root)
    assert {r.chart for r in held.read("windows").collect()} == {f"s{i}/maidata.txt" for i in range(4)} and len(held.generations()) == 1
    assert commands.index(spark, args) == root and len(held.generations()) == 1
    (songs / "s2" / "maidata.txt").write_text("&title=t2\n&lv_5=13\n&inote_5=\n(120){4}1,2,3,4,5,E")
    commands.index(spark, args)
    newest = held.generations()[-1]["generation"]
    assert len(held.generations()) == 2
    assert {r.chart for r in spark.read.parquet(f"{root}/windows").where(F.col("generation") == newest).collect()} == {"s2/maidata.txt"}
    assert json.loads(held.generations()[0]["config"])["window"]["train_stride_sec"] == 2


def test_what_was_made_is_saved_with_its_audio(spark, tmp_path):
    audio = tmp_path / "given" / "track.mp3"
    audio.parent.mkdir()
    audio.write_bytes(bytes(range(256)) * 40_000)
    frames = T.frames(spark, DIR).where("chart < 4")
    made = render.single(frames, 5)
    told = made.withColumn("chart", F.concat(F.lit("songs/"), "chart")).withColumn("audio", F.when(F.col("chart").endswith("1"), F.lit(str(audio))))
    told = told.unionAll(spark.createDataFrame([("songs/none", None, str(audio))], told.schema))
    rows = S.save(told, str(tmp_path / "out")).collect()
    texts = {f"songs/{r.chart}": r.text for r in made.collect()}
    assert {r.chart for r in rows} == set(texts) and all(t.startswith("&title=generated\n&artist=default\n") for t in texts.values())
    for r in rows:
        home = tmp_path / "out" / r.chart
        assert (home / "maidata.txt").read_text() == texts[r.chart]
        assert sorted(f.name for f in home.iterdir()) == ["maidata.txt"] + ["track.mp3"] * r.chart.endswith("1")
    assert (tmp_path / "out" / "songs" / "1" / "track.mp3").read_bytes() == audio.read_bytes()


def test_the_catalogues_digest_ignores_the_order_of_songs(spark):
    rows = [(str(i), f"t{i}", ["13", "13+"], [13.0, 13.7], ("pop",)) for i in range(20)]
    made = [spark.createDataFrame(r, S.CATALOGUE).repartition(n) for r, n in ((rows, 1), (rows[::-1], 3), (rows[:-1], 2))]
    a, b, c = map(S.catalogue_version, made)
    assert a == b != c and len(a) == 64


def test_an_index_without_checks_keeps_every_chart(spark):
    """The plain form: no catalogue, no rejection; charts that can't be read are left out and counted."""
    head = "&lv_5=13\n&inote_5=\n"
    texts = [("good", head + "(120){4}1,2,3,E"), ("crowded", head + "(6000){4}1,1,1,1,E"), ("bad", head + "(120){4}9,E"), ("other", "&inote_2=(120){4}1,E")]
    df = spark.createDataFrame(texts, "chart string, text string")
    songs = df.select("chart", F.lit(300).cast("long").alias("feature_frames"))
    plain, strict = (charts.build_index(df, songs, validate=v) for v in (False, True))
    assert {r.chart for r in plain.windows.collect()} == {"good", "crowded"} and {r.chart for r in strict.windows.collect()} == {"good"}
    told = charts.statistics(plain.windows, plain.errors).first()
    assert (told.charts, told.windows, told.parse_errors) == (2, 8, 1)


def test_the_spine_is_never_broadcast(spark):
    """A filter that leaves empty windows out makes the outer join an inner one, whose smaller side by Spark's estimate is the spine."""
    from metrolith.plans import registry

    for name in ("windows_too_long", "window_index"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_masks_of_a_batch(spark):
    rows = spark.createDataFrame([(0, [1, 3, 4, 2], 2), (1, [1, 2], 1), (2, [1], 5), (3, [], 0)], "i long, tokens array<int>, loss_start int")
    made = windows.collate(rows, 4, 6, "i").first()
    assert [sum(m) for m in made["mask"]] == [4, 2, 1, 0] and all(m == sorted(m, reverse=True) and len(m) == 6 for m in made["mask"])
    assert made["loss_mask"] == [[False, False, True, True, False, False], [False, True] + [False] * 4, [False] * 6, [False] * 6]


def test_notes_held_are_the_same(spark):
    given = spark.createDataFrame([(1, "&inote_5=(120){4}1,2h[4:1],E"), (2, "&inote_5=(120){4}1,9,E"), (3, "&inote_5=(120){x}1,E"), (4, None)], "chart long, text string")
    a, b = parse.parse(given), parse.parse(given, held=True)
    for name in ("frames", "errors", "warnings", "levels", "charts"):
        told = lambda p: sorted(map(str, getattr(p, name).collect()))
        assert told(a) == told(b)
    held = b.frames.unionAll(b.frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in held  # what is read stands in the checkpoint
