"""Overlapping windows with a context before a target: which events fall in which window, and the window index.

An event falls in a handful of windows that follow from its time alone, so members are exploded from events and met by
key with the spine of all windows; no range join is planned, and empty windows stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import notes as N
from metrolith.functions import vocabulary as V


@dataclass(frozen=True)
class Windows:
    """Seconds in a window where context and target start and the target ends; seconds between windows; features."""

    prefix_start: float = V.PREFIX_START
    target_start: float = V.TARGET_START
    target_end: float = V.TARGET_END
    stride: float = V.TRAIN_STRIDE
    hz: int = V.FEATURE_HZ
    features: int = V.FEATURE_FRAMES

    @property
    def edges(self) -> tuple[int, int, int]:
        return tuple(int(x) for x in (round(self.prefix_start * 100), round(self.target_start * 100), round(self.target_end * 100)))


def target_start(k: Column, w: Windows) -> Column:
    return k.cast("double") * w.stride


def members(events: DataFrame, w: Windows = Windows(), time: str = "time_sec") -> DataFrame:
    """A row for each event and window (k = 0, 1 ..) that holds it: the columns of events, k, rel_cs, part."""
    before, behind = w.target_end - w.target_start, w.target_start - w.prefix_start
    t = F.col(f"`{time}`")
    first = F.greatest(F.lit(0), F.floor((t - before - 0.01) / w.stride))
    last = F.floor((t + behind + 0.01) / w.stride)
    each = events.where(last >= first).withColumn("k", F.explode(F.sequence(first, F.greatest(last, first))))
    window_start = target_start(F.col("k"), w) - w.target_start
    each = each.withColumn("rel_cs", F.rint((t - window_start) * 100).cast("long"))
    a, b, c = w.edges
    part = F.when(F.col("rel_cs").between(a, b - 1), "prefix").when(F.col("rel_cs").between(b, c - 1), "target")
    return each.withColumn("part", part).where("part is not null")


def spine(groups: DataFrame, w: Windows = Windows(), length: str = "length_sec") -> DataFrame:
    """A row for each window of each group: the columns of groups, k, target_start, window_start."""
    n = F.ceil(F.col(f"`{length}`") / w.stride).cast("long")
    each = groups.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return each.withColumn("target_start", target_start(F.col("k"), w)).withColumn("window_start", F.col("target_start") - w.target_start)


def feature_range(window_start: Column, frames: Column, w: Windows = Windows()) -> dict[str, Column]:
    """source_start, source_end and left_pad of a window over `frames` feature frames."""
    logical = F.rint(window_start * w.hz).cast("long")
    start = F.greatest(F.lit(0).cast("long"), logical)
    return {"source_start": start, "source_end": F.greatest(start, F.least(frames.cast("long"), logical + w.features)), "left_pad": start - logical}


def index(frames: DataFrame, songs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """The window index. frames: chart, time_sec, notes. songs: chart, feature_frames. A row for each window, even an empty
    one: chart, k, target_start, window_start, source_start, source_end, left_pad, tokens, loss_start."""
    held = members(frames.where(F.size("notes") > 0).select("chart", "time_sec", "notes"), w)
    coded = held.select("chart", "k", "time_sec", "part", N.frame_tokens(F.col("rel_cs") / 100.0, F.col("notes")).alias("tokens"))
    gathered = coded.groupBy("chart", "k").agg(
        F.array_sort(F.collect_list(F.struct("time_sec", "tokens"))).alias("all"),
        F.sum(F.when(F.col("part") == "prefix", F.size("tokens")).otherwise(0)).alias("before"),
    )
    # Merged, whatever is asked of the result: to Spark the spine looks as small as the songs it is made from, and where empty
    # windows are left out it would be broadcast.
    every = spine(songs.withColumn("length_sec", F.col("feature_frames") / float(w.hz)), w).join(gathered.hint("merge"), ["chart", "k"], "left")
    body = F.flatten(F.transform("all", lambda s: s["tokens"]))
    tokens = F.concat(F.array(F.lit(V.SOS)), F.coalesce(body, F.array().cast("array<int>")), F.array(F.lit(V.EOS)))
    return every.withColumns(feature_range(F.col("window_start"), F.col("feature_frames"), w)).select(
        "chart", "k", "target_start", "window_start", "source_start", "source_end", "left_pad", tokens.alias("tokens"), (1 + F.coalesce("before", F.lit(0))).cast("int").alias("loss_start")
    )


def loss_mask(tokens: Column, loss_start: Column) -> Column:
    return F.transform(tokens, lambda t, i: i >= loss_start)


def prefix_tokens(frames: Column, window_start: Column, w: Windows = Windows()) -> Column:
    """The context of a window from an array of frames (time_sec, notes): quantised first, then tested."""
    a, b, _ = w.edges
    rel = lambda f: F.rint((f["time_sec"] - window_start) * 100)
    kept = F.filter(frames, lambda f: rel(f).between(a, b - 1))
    return F.concat(F.array(F.lit(V.SOS)), F.flatten(F.transform(kept, lambda f: N.frame_tokens(rel(f) / 100.0, f["notes"]))))


def too_long(index: DataFrame, longest: int) -> DataFrame:
    """Windows with more than `longest` tokens: these are refused, never cut."""
    return index.where(F.size("tokens") > longest)


def window_features(features: Column, left_pad: Column, source_start: Column, source_end: Column, w: Windows = Windows()) -> dict[str, Column]:
    """`features` of a window from a song's array of feature frames, zeros where there are none, and `mask`."""
    zero = F.transform(F.get(features, F.lit(0)), lambda x: F.lit(0).cast("float"))
    pad = lambda n: F.array_repeat(zero, n.cast("int"))
    n = source_end - source_start
    left = F.least(left_pad, F.lit(w.features))
    out = F.concat(pad(left), F.slice(features, (source_start + 1).cast("int"), n.cast("int")), pad(w.features - left - n))
    mask = F.transform(F.sequence(F.lit(0), F.lit(w.features - 1)), lambda i: (i >= left_pad) & (i < left_pad + n))
    return {"features": out, "mask": mask}


def numbered(rows: DataFrame, order: str, span: int = 4096) -> DataFrame:
    """Adds `place`, a dense number from 0 in the order of `order`, a whole number (rows with equal or null ones: in any
    order, null first). Ranges of `span` are counted, then ranges of span * span: of ids that are about dense, one task sees a
    row for each 16 million."""
    small = rows.withColumn("__small", F.floor(F.col(f"`{order}`") / span))
    counts = small.groupBy("__small").agg(F.count("*").alias("__n")).withColumn("__large", F.floor(F.col("__small") / span))
    up_to = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = counts.groupBy("__large").agg(F.sum("__n").alias("__n")).select(F.col("__large").alias("__key"), up_to(Window.orderBy("__large")).alias("__base"))
    within = counts.withColumn("__within", up_to(Window.partitionBy("__large").orderBy("__small")))
    offsets = within.join(large, F.col("__large").eqNullSafe(F.col("__key"))).select(F.col("__small").alias("__key"), (F.col("__base") + F.col("__within")).alias("__offset"))
    own = small.withColumn("__own", F.row_number().over(Window.partitionBy("__small").orderBy(F.col(f"`{order}`"))) - 1)
    placed = own.join(offsets, F.col("__small").eqNullSafe(F.col("__key")))
    return placed.withColumn("place", F.col("__own") + F.col("__offset")).drop("__small", "__own", "__key", "__offset")


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Adds `batch` and `place`: rows numbered within spans of `order`, which must be a dense number from 0."""
    return rows.withColumns({"batch": F.floor(F.col(order) / size).cast("long"), "place": F.pmod(F.col(order), F.lit(size)).cast("int")})


def collate(rows: DataFrame, size: int, longest: int, order: str, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each batch of `size` rows: batch, tokens (a sequence for each row, padded to `longest`), mask (what is no
    padding), loss_mask (what counts, from loss_start to the end), and the columns of `also`, an array each. rows: tokens,
    loss_start, and `order`, a dense number from 0. A row with more than `longest` tokens is refused, never cut."""
    n = F.size("tokens")
    fits = F.when(n > longest, F.raise_error(F.format_string(f"a window of %d tokens doesn't fit {longest}", n)).cast("int")).otherwise(n)
    pad = lambda first, value: F.concat(first, F.array_repeat(F.lit(value), longest - F.size(first)))
    run = lambda value, many: F.array_repeat(F.lit(value), many)
    begin = lambda r: F.least(r["loss_start"], F.size(r["tokens"]))
    told = batches(rows.withColumn("__n", fits), size, order).select("batch", F.struct("place", F.when(F.col("__n") >= 0, F.col("tokens")).alias("tokens"), "loss_start", *also).alias("row"))
    gathered = told.groupBy("batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))  # padded behind the shuffle, as padding is most of a batch
    return gathered.select(
        "batch",
        F.transform("rows", lambda r: pad(r["tokens"], V.PAD)).alias("tokens"),
        F.transform("rows", lambda r: pad(run(True, F.size(r["tokens"])), False)).alias("mask"),
        F.transform("rows", lambda r: pad(F.concat(run(False, begin(r)), run(True, F.size(r["tokens"]) - begin(r))), False)).alias("loss_mask"),
        *[F.col(f"rows.{c}").alias(c) for c in also],
    )
