"""Constraints, matching, lookup, windows, splits, configuration and materialised tables against plain versions."""

import hashlib
import json
import random

import pytest
from metrolith import config
from metrolith.functions import notes as N
from metrolith.functions import quantize as Q
from metrolith.functions import vocabulary as V
from metrolith.operators import constraints, lookup, matching, segments, split, windows
from metrolith.plans import charts as C
from metrolith.sources import charts as S
from metrolith.sources import materialise
from pyspark.sql import functions as F


def taps(spark, rows):
    """rows: chart, time in cs, lane, hold in cs or None."""
    df = spark.createDataFrame(rows, "chart long, cs long, lane int, hold long")
    none = F.lit(None)
    note = F.struct(F.when(F.col("hold").isNull(), "TAP").otherwise("HOLD").alias("type"), "lane", none.alias("area"), (F.col("hold") / 100.0).alias("hold_sec"), none.alias("f"), none.alias("s"), F.lit(False).alias("b"), F.lit(False).alias("x")).cast(N.NOTE)
    return df.groupBy("chart", (F.col("cs") / 100.0).alias("time_sec")).agg(F.collect_list(note).alias("notes")).withColumn("level", F.lit(5))


def plain_rejects(rows):
    """Times of refused frames of one chart, by the sequential rule."""
    frames, until, last, out = {}, {}, {}, []
    for cs, lane, hold in rows:
        frames.setdefault(cs, []).append((lane, hold))
    for cs in sorted(frames):
        notes = frames[cs]
        if len(notes) > 2 or len({x for x, _ in notes}) < len(notes):
            out.append(cs)
            continue
        for lane, hold in notes:
            if lane in until and cs <= until[lane] + 5 or lane in last and cs - last[lane] < 3:
                out.append(cs)
                break
            last[lane] = cs
            if hold:
                until[lane] = cs + hold
    return out


def test_violations_follow_the_sequential_rule(spark):
    draw = random.Random(5)
    rows = []
    for chart in range(60):
        some = {(draw.randrange(0, 400), draw.randrange(1, 5)): draw.choice([None, None, draw.randrange(1, 30)]) for _ in range(draw.choice([2, 6, 14]))}
        rows += [(chart, cs, lane, hold) for (cs, lane), hold in some.items()]
    frames = taps(spark, rows)
    got = {}
    for r in constraints.violations(frames).collect():
        got.setdefault(r["chart"], []).append(round(r["time_sec"] * 100))
    want = {c: w for c in range(60) if (w := plain_rejects([r[1:] for r in sorted(rows, key=str) if r[0] == c]))}
    assert {c: sorted(g) for c, g in got.items()} .keys() == want.keys()
    single = {c for c in want if len({r[1] for r in rows if r[0] == c}) == sum(r[0] == c for r in rows)}
    assert {c: sorted(got[c]) for c in single} == {c: want[c] for c in single}  # with one note at a time the order is fixed
    assert {r["chart"] for r in constraints.conflicts(frames).collect()} == want.keys()


@pytest.mark.parametrize("rows,bad", [([(0, 1, 10), (15, 1, None)], True), ([(0, 1, 10), (16, 1, None)], False), ([(0, 1, None), (2, 1, None)], True), ([(0, 1, None), (3, 1, None)], False), ([(0, 1, None), (0, 2, None), (0, 3, None)], True)])
def test_boundaries(spark, rows, bad):
    assert (constraints.conflicts(taps(spark, [(1, *r) for r in rows])).count() > 0) == bad


def plain_match(predicted, truth, tolerance):
    used, tp = [False] * len(truth), 0
    for t, key in predicted:
        best, nearest = -1, tolerance
        for i, (u, other) in enumerate(truth):
            if not used[i] and key == other and abs(t - u) <= nearest + 1e-9:
                best, nearest = i, abs(t - u)
        if best >= 0:
            used[best] = True
            tp += 1
    return tp, len(predicted), len(truth)


def test_greedy_matching(spark):
    draw = random.Random(9)
    pred, true, want = [], [], {}
    for chart in range(80):
        make = lambda n: sorted((draw.randrange(0, 40) / 200, draw.choice("ab")) for _ in range(n))
        p, t = make(draw.randrange(0, 14)), make(draw.randrange(0, 14))
        if p or t:
            want[chart] = plain_match(p, t, 0.01)
        pred += [(chart, *x) for x in p]
        true += [(chart, *x) for x in t]
    side = lambda rows: spark.createDataFrame(rows, "chart long, time_sec double, key string")
    got = {r["chart"]: (r["tp"], r["n_predicted"], r["n_true"]) for r in matching.counts(side(pred), side(true)).collect()}
    assert got == want
    assert matching.scores(matching.counts(side([]), side([]))).first()["f1"] == 0.0


def test_match_edges(spark):
    side = lambda *t: spark.createDataFrame([(1, x, "k") for x in t], "chart long, time_sec double, key string")
    count = lambda p, t: tuple(matching.counts(p, t).select("tp", "n_predicted", "n_true").first())
    assert count(side(1.01, 1.01), side(1.0)) == (1, 2, 1)
    assert count(side(1.011), side(1.0)) == (0, 1, 1)


def test_index_of_a_small_song(spark):
    frames = taps(spark, [(7, 0, 1, None), (7, 799, 2, None), (7, 800, 3, None), (7, 1200, 4, None)])
    songs = spark.createDataFrame([(7, 1500)], "chart long, feature_frames long")
    out = {r["k"]: r for r in windows.index(frames, songs, windows.Windows(stride=10.0)).collect()}
    assert sorted(out) == [0, 1]
    assert out[0]["tokens"][:7] == [1, 3, 1205, 3046, 3005, 4, 3] and out[0]["loss_start"] == 1 and out[0]["left_pad"] == 900
    assert out[1]["tokens"][1:3] == [3, 5 + 999] and out[1]["loss_start"] == 11


def test_lookup_order(spark):
    cat = spark.createDataFrame([("1", "t", ["11", "13"], [1.0, 2.0], ("pop",)), ("2", "t", ["11", "13+"], [1.0, 2.0], ("pop",)), ("3", "u", ["5"], [1.0], ("x",)), ("4", "u", ["5"], [1.0], ("x",))], S.CATALOGUE)
    rows = [("id", "zz", "2", {2: "1"}), ("exact", "t", None, {2: "11", 3: "13"}), ("loose", "t", None, {2: "11", 3: "13.5"}), ("two", "u", None, {2: "5"}), ("none", "t", "99", {6: "1"}), ("null", None, None, None)]
    got = dict(lookup.match(spark.createDataFrame(rows, "chart string, title string, short_id string, local_levels map<int,string>"), cat).select("chart", "song_id").collect())
    assert got == {"id": "2", "exact": "1", "loose": "2", "two": None, "none": None, "null": None}


def test_split_keeps_groups_together(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 37)
    train, val = split.by_group(rows, "g")
    a, b = ({r["g"] for r in x.select("g").distinct().collect()} for x in (train, val))
    assert not a & b and len(b) == 5 and train.count() + val.count() == 1000
    assert split.sample_groups(rows, "g", 3).select("g").distinct().count() == 3


@pytest.mark.parametrize(("n", "ratio"), [(1, 0.15), (40, 0.15), (700, 0.15), (40, 1.0)])
def test_validation_groups_are_the_first_by_hash(spark, n, ratio):
    got = {r["g"] for r in split.validation_groups(spark.range(3 * n).select((F.col("id") % n).alias("g")), "g", ratio, 42).collect()}
    assert got == set(sorted(range(n), key=lambda g: (hashlib.md5(f"42:{g}".encode()).hexdigest(), g))[: max(1, int(n * ratio))])


def test_validation_groups_of_no_rows(spark):
    assert split.validation_groups(spark.range(0).withColumnRenamed("id", "g"), "g", 0.15, 42).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    draw = random.Random(9)
    ids = [None, -9000, -1, 0, 5, 5, 2**40, 2**40 + 1] + [draw.randrange(0, 3000) for _ in range(200)]
    got = windows.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 8).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(ids)))
    assert [r["id"] for r in got] == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_segments_in_runs_follow_the_sequential_rule(spark):
    draw = random.Random(3)
    rows = []
    for chart in range(40):
        reach = draw.choice([6000, 20_000, 90_000])
        times = {draw.randrange(-5000 if chart % 4 == 0 else 0, reach) for _ in range(draw.choice([1, 8, 30]))}
        rows += [(chart, cs, 1, draw.choice([None, None, draw.randrange(1, 8000)])) for cs in sorted(times)]
    want = []
    for chart in range(40):
        offset = end = None
        for cs, hold in ((r[1], r[3]) for r in rows if r[0] == chart):
            at, until = cs / 100.0, cs / 100.0 + (hold or 0) / 100.0
            if offset is None:
                offset, end = 0.0, until
                want.append([chart, offset, 1])
                continue
            end = max(end, until)
            if end - offset > 30.0:
                offset, end = at, until
                want.append([chart, offset, 0])
            want[-1][2] += 1
    got = segments.cut(taps(spark, rows)).orderBy("chart", "segment").collect()
    assert [[r["chart"], r["offset_sec"], sum(t == V.FRAME_START for t in r["tokens"])] for r in got] == sorted(want)  # numbered by offset


def test_time_of_each_repeats_the_last_time(spark):
    draw = random.Random(4)
    some = [[], [3], [V.TS_BASE], [3, 4]] + [[draw.choice([V.SOS, V.FRAME_START, V.TS_BASE + draw.randrange(0, 3000)]) for _ in range(draw.randrange(1, 50))] for _ in range(40)]
    want = []
    for tokens in some:
        last, each = None, []
        for t in tokens:
            last = t if V.TS_BASE <= t < V.TS_BASE + V.TS_COUNT else last
            each.append(last)
        want.append(each)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t array<int>").select("i", Q.time_of_each(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == want


def test_config_rules():
    good = json.loads(config.as_json(config.Config()))
    assert config.load(good) == config.Config()
    for path, value in (("window.target_end_sec", 31.0), ("window.infer_stride_sec", 9.0), ("window.prefix_start_sec", 12.0), ("training.rotations", 9), ("training.val_ratio", 1.0), ("audio.context_sec", 15.0), ("training.level", True)):
        bad = json.loads(json.dumps(good))
        section, name = path.split(".")
        bad[section][name] = value
        with pytest.raises(ValueError):
            config.load(bad)
    with pytest.raises(ValueError, match="unknown"):
        config.load(good | {"more": 1})
    with pytest.raises(ValueError, match="missing"):
        config.load({"window": good["window"]})
    other = config.load(good | {"training": good["training"] | {"max_tokens": 64}})
    assert config.same_for_inference(config.Config(), other) == ["training.max_tokens"]


def test_files_become_an_index(spark, tmp_path):
    root, made = tmp_path / "charts", tmp_path / "features"
    for name, text in (("a/x", "&title=T\n&inote_5=(120){4}1,2,E"), ("b", "&title=U\n&inote_5=(120){4}9,E"), ("c", "&title=V\n&inote_5=(120){4}1,{#0.01}1,1,E"), ("d", "&title=W")):
        (root / name).mkdir(parents=True)
        (root / name / "maidata.txt").write_text(text)
        (root / name / "track.mp3").write_bytes(b"0")
    made.mkdir()
    (root / "d/track.mp3").unlink()
    names = {r[0]: r[1] for r in spark.createDataFrame([("a/x",), ("b",), ("c",), ("d",)], "f string").select("f", S.feature_name(F.col("f"))).collect()}
    for f in names.values():
        (made / f).write_bytes(b"00")
    found = S.scan(spark, str(root), str(made))
    assert sorted(r["chart"] for r in found.collect()) == ["a/x/maidata.txt", "b/maidata.txt", "c/maidata.txt"]
    songs = found.select("chart", F.lit(1500).cast("long").alias("feature_frames"))
    built = C.build_index(S.texts(spark, str(root)), songs, S.catalogue(spark, str(tmp_path / "none.json")), w=windows.Windows(stride=10.0))
    assert {r["chart"] for r in built.windows.collect()} == {"a/x/maidata.txt"} and built.windows.count() == 2
    assert [r["chart"] for r in built.errors.collect()] == ["b/maidata.txt"] and {r["rule"] for r in built.rejected.collect()} == {"RESOURCE_CONFLICT"}
    with pytest.raises(ValueError):
        C.build_index(S.texts(spark, str(root)), songs, fail_fast=True)
    calls = []

    def build():
        calls.append(1)
        return {"windows": built.windows}

    store, settings = str(tmp_path / "store"), config.as_json(config.Config())
    one = materialise.ensure(spark, store, settings, found, build)
    assert materialise.ensure(spark, store, settings, found, build) == one and len(calls) == 1
    two = materialise.ensure(spark, store, settings, found.where("chart like 'a%'"), build)
    assert two != one and len(calls) == 2 and spark.read.parquet(f"{two}/windows").count() == 2


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from metrolith.streaming import committed

    rows = [("s", k, str(k)) for k in range(4)] + [("t", 0, "9")]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "chart string, k long, payload string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("chart string, k long, payload string").parquet(str(source))

    def model(seen, payload, k):
        return [k * 1000 + 10 * len(seen) + 500, k * 1000 + 999, k * 1000 + 1000]

    run = committed.generate(stream, model).writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("made").collect())
    want, kept = [], []
    for k in range(4):
        seen = [t for t in kept if k * 1000 - 600 <= t < k * 1000]
        own = [t for t in model(seen, "", k) if k * 1000 <= t < k * 1000 + 1000]
        kept += own
        want += [("s", k, t) for t in own]
    assert got == sorted(want + [("t", 0, t) for t in model([], "", 0)[:2]])


def test_commands(spark, tmp_path):
    from metrolith import __main__ as M

    root, made = tmp_path / "charts", tmp_path / "features"
    (root / "a").mkdir(parents=True)
    made.mkdir()
    (root / "a/maidata.txt").write_text("&title=T\n&inote_5=(120){4}1,2h[4:1],E")
    (root / "a/track.mp3").write_bytes(b"0")
    name = spark.range(1).select(S.feature_name(F.lit("a"))).first()[0]
    (made / name).write_bytes(b"0" * (128 + 768 * 2 * 1500))
    args = M.arguments().parse_args(["index", "--charts", str(root), "--features", str(made), "--out", str(tmp_path / "out"), "--stride", "10"])
    folder = M.index(spark, args)
    assert spark.read.parquet(f"{folder}/windows").count() == 2 and M.index(spark, args) == folder
    M.audit(spark, M.arguments().parse_args(["audit", "--charts", str(root), "--out", str(tmp_path / "audit")]))
    assert spark.read.parquet(str(tmp_path / "audit/changed")).count() == 0
    with pytest.raises(SystemExit):
        M.arguments().parse_args(["index", "--charts", "x", "--features", "y", "--out", "z", "--level", "7"])
