"""Augmentation: whole rotations of token sequences, noise and time masks on feature arrays; array numerics of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import durations as D
from metrolith.functions import vocabulary as V
from metrolith.functions.quantize import rotate_tokens
from metrolith.operators import decode


def rotations(rows: DataFrame, n: int = 8, tokens: str = "tokens") -> DataFrame:
    """Each row n times, with `steps` 0 .. n - 1 and its tokens turned by them."""
    if not 1 <= n <= 8:
        raise ValueError("rotations must be 1 to 8")
    each = rows.withColumn("steps", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn(tokens, rotate_tokens(F.col(tokens), F.col("steps")))


def unsound_rotations(rows: DataFrame) -> DataFrame:
    """tokens, steps, reason: the sequences (tokens, from the start mark to the end mark) that don't turn as they should."""
    turned = rows.select(F.filter("tokens", lambda t: t != V.PAD).alias("tokens")).withColumn("steps", F.explode(F.sequence(F.lit(0), F.lit(8))))
    row = rotate_tokens(F.col("tokens"), F.col("steps"))
    turned = turned.withColumns({"row": row, "back": rotate_tokens(row, 8 - F.col("steps"))})
    centre = F.lit(V.TOUCH_BASE + 16)
    reasons = [
        (F.col("steps").isin(0, 8) & (F.col("row") != F.col("tokens")), "a whole turn changes it"),
        (F.col("back") != F.col("tokens"), "turning back doesn't give it again"),
        ((F.get("row", F.lit(0)) != V.SOS) | (F.element_at("row", -1) != V.EOS), "a mark at an end is lost"),
        (F.size(F.filter("row", lambda t: t == centre)) != F.size(F.filter("tokens", lambda t: t == centre)), "the centre turns"),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in reasons])
    told = turned.withColumn("reason", reason)
    read = decode.tolerant(told.where("reason is null").select("tokens", "steps", "row"), "row").where(F.size("warnings") > 0)
    return told.where("reason is not null").select("tokens", "steps", "reason").unionAll(read.select("tokens", "steps", F.concat_ws(", ", "warnings")))


def _mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def variance(x: Column) -> Column:
    """Population variance of an array of doubles."""
    return D.let(_mean(x), lambda mean: F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v) / F.size(x))


def standardised(x: Column) -> Column:
    mean, deviation = _mean(x), F.sqrt(variance(x) + 1e-7)
    return F.transform(x, lambda v: (v - mean) / deviation)


def drawn(seed: int, *what: Column) -> Column:
    """A number above 0 and below 1 that follows from the seed and what is drawn for, by counter: the first 48 bits of md5
    over their texts joined by colons, so any engine draws the same and a lost task draws it again."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[w.cast("string") for w in what])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def disturbed(rows: DataFrame, features: str, mask: str, chance: float, noise: float, longest: int, seed: int, key: str) -> DataFrame:
    """With a chance, noise in proportion to the deviation of the valid frames, and a run of 1 .. longest valid frames set to
    zero. All draws follow from seed, key and place (see drawn)."""
    u = lambda *x: drawn(seed, F.col(key), *x)
    x, m = F.col(features), F.col(mask)
    some = D.worked_out(rows, __valid=F.filter(F.transform(x, lambda f, i: F.when(F.get(m, i), f)), lambda f: f.isNotNull()))
    flat = F.transform(F.flatten("__valid"), lambda v: v.cast("double"))
    deviation = F.when(F.size(flat) > 0, F.sqrt(variance(flat))).otherwise(F.lit(0.0))
    normal = lambda i, j: F.sqrt(-2 * F.ln(u(F.lit("a"), i, j))) * F.cos(2 * 3.141592653589793 * u(F.lit("b"), i, j))
    n = F.size("__valid")
    size = F.when((n > 1) & F.lit(longest > 0), F.least(F.lit(longest), n - 1))
    told = D.worked_out(some, __deviation=deviation, __run=F.floor(u(F.lit("run")) * size).cast("int") + 1, __chosen=u(F.lit("chance")) < chance)
    first = F.coalesce(F.array_position(m, True).cast("int") - 1, F.lit(0))
    begin = first + F.floor(u(F.lit("begin")) * (n - F.col("__run") + 1)).cast("int")
    told = D.worked_out(told, __begin=begin).withColumn("__end", F.col("__begin") + F.col("__run"))
    zeroed = lambda i: F.coalesce((i >= F.col("__begin")) & (i < F.col("__end")), F.lit(False))
    noisy = lambda v, i, j: F.when(F.get(m, i) & F.lit(noise > 0), v + noise * F.col("__deviation") * normal(i, j)).otherwise(v.cast("double"))
    changed = F.transform(x, lambda f, i: F.transform(f, lambda v, j: F.when(zeroed(i), F.lit(0.0)).otherwise(noisy(v, i, j)).cast("float")))
    return told.withColumn(features, F.when(F.col("__chosen"), changed).otherwise(x)).drop("__valid", "__deviation", "__run", "__begin", "__end", "__chosen")


def chunks(songs: DataFrame, rate: int, stride: int, core_sec: float = 30.0, context_sec: float = 10.0) -> DataFrame:
    """Overlapping chunks of songs (chart, samples): chart, core_start, core_end, input_start, input_end. Cores lie side by
    side, inputs start on the stride."""
    core, context = round(core_sec * rate), round(context_sec * rate)
    n = F.ceil(F.col("samples") / core).cast("long")
    each = songs.where("samples > 0").select("chart", "samples", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    start = F.col("k") * core
    end = F.least(F.col("samples"), start + core)
    lead = F.greatest(F.lit(0), start - context)
    return each.select("chart", start.alias("core_start"), end.alias("core_end"), (lead - F.pmod(lead, F.lit(stride))).alias("input_start"), F.least(F.col("samples"), end + context).alias("input_end"))


def audio_slice(samples: Column, begin_sec: Column, end_sec: Column, rate: int = 22_050, hop: int = 256) -> Column:
    """Frames between two times, within what there is."""
    n = F.size(samples)
    a = F.greatest(F.lit(0), F.least(n, (begin_sec * rate / hop).cast("int")))
    b = F.greatest(a, F.least(n, (end_sec * rate / hop).cast("int")))
    return F.slice(samples, a + 1, b - a)
