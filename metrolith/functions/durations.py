"""Durations in notation text: reading `D:M`, `#S`, `B#D:M`, `W##...`, and writing them. All as columns; null is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
#: Denominators that are tried in turn when a duration is written, and how far a numerator may be off.
DENOMINATORS, OFF = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 1280), 0.02


def number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).cast("double"))


def before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """Behind the first `mark`."""
    return F.regexp_replace(text, f"(?s)^.*?{mark}", "")


def _or_zero(text: Column) -> Column:
    return F.when(text == "", F.lit(0.0)).otherwise(number(text))


def whole(bpm: Column) -> Column:
    """Seconds of a whole note; a bpm of zero or less gives zero."""
    return F.when(bpm > 0, F.try_divide(F.lit(240.0), bpm)).otherwise(F.lit(0.0))


def let(value: Column, use) -> Column:
    """use(value), with the value written once in the plan however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that later steps only refer to: behind a generator of one row, no filter or projection on them
    is rewritten in terms of what they are made of, which would repeat it for each mention."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def seconds(text: Column, bpm: Column) -> Column:
    waits = text.contains("##")
    bound = F.struct(
        F.when(waits, _or_zero(before(text, "##"))).otherwise(F.lit(0.0)).alias("wait"),
        F.when(waits, after(text, "##")).otherwise(text).alias("rest"),
        bpm.alias("bpm"),
    )

    def with_beats(v: Column) -> Column:
        given = v["rest"].contains("#")
        beats = F.when(given, after(v["rest"], "#")).otherwise(v["rest"])
        return F.struct(
            v["wait"].alias("wait"),
            F.when(v["rest"].startswith("#"), number(F.substring(v["rest"], 2, 1 << 30))).alias("plain"),
            v["rest"].startswith("#").alias("is_plain"),
            F.when(given, number(before(v["rest"], "#"))).otherwise(v["bpm"]).alias("own"),
            number(before(beats, ":")).alias("divider"),
            F.when(beats.contains(":"), number(after(beats, ":"))).otherwise(F.lit(1.0)).alias("many"),
        )

    def length(v: Column) -> Column:
        step = F.try_divide(F.try_divide(F.lit(240.0), v["own"]), v["divider"]) * v["many"]
        known = v["own"].isNotNull() & v["divider"].isNotNull() & v["many"].isNotNull()
        beats = F.when((v["own"] > 0) & (v["divider"] > 0), step).otherwise(F.when(known, F.lit(0.0)))
        return v["wait"] + F.when(v["is_plain"], v["plain"]).otherwise(beats)

    return F.when(text == "", F.lit(0.0)).otherwise(let(let(bound, with_beats), length))


def slide_times(text: Column, bpm: Column, strict: bool = False) -> Column:
    """struct(wait, trace); without a wait of its own a slide waits a whole note. strict: a plain number after `##` is seconds."""
    waits = text.contains("##")
    bound = F.struct(text.alias("text"), bpm.alias("bpm"), waits.alias("waits"), F.when(waits, after(text, "##")).otherwise(text).alias("rest"))

    def parts(v: Column) -> Column:
        """What the trace is: seconds as they stand, or a length at a bpm."""
        rest = v["rest"]
        marks = F.length(rest) - F.length(F.replace(rest, F.lit("#")))
        own = F.when(rest.contains("#"), number(before(rest, "#"))).otherwise(v["bpm"])
        stands = F.when(v["waits"], rest.startswith("#") | (F.lit(strict) & rest.rlike(NUMBER))).otherwise((marks == 1) & ~rest.contains(":"))
        wait = F.when(v["waits"], _or_zero(before(v["text"], "##"))).when(rest.contains("#"), F.try_divide(F.lit(240.0), own)).otherwise(whole(v["bpm"]))
        inner = F.when(rest.contains("#"), after(rest, "#")).otherwise(rest)
        return F.struct(wait.alias("wait"), stands.alias("stands"), inner.alias("inner"), own.alias("own"))

    def both(v: Column) -> Column:
        return F.struct(v["wait"].alias("wait"), F.when(v["stands"], number(v["inner"])).otherwise(seconds(v["inner"], v["own"])).alias("trace"))

    return let(let(bound, parts), both)


def fraction(beats: Column) -> Column:
    """`D:M` with the first denominator that fits within two per cent, else null."""

    def fits(d: Column) -> Column:
        m = F.rint(beats * d)
        return (m > 0) & (F.abs(beats * d - m) / F.greatest(m, F.lit(1.0)) < OFF)

    first = F.get(F.filter(F.array(*[F.lit(d) for d in DENOMINATORS]), fits), F.lit(0))
    return let(first, lambda d: F.when(d.isNotNull(), F.concat_ws(":", d.cast("string"), F.rint(beats * d).cast("long").cast("string"))))


def decimal(value: Column, places: int) -> Column:
    """Fixed places without the zeros at the end."""
    text = F.format_string(f"%.{places}f", value)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def written(length: Column, bpm: float) -> Column:
    """A hold's length in notation; no time at all is written as one whole note."""
    return F.when(length <= 0, F.lit("1:1")).otherwise(F.coalesce(fraction(length * bpm / 240.0), F.concat(F.lit("#"), decimal(length, 6))))


def slide_written(wait: Column, trace: Column, bpm: float) -> Column:
    """The bracket of a slide's segment: plain if the wait is the default, else at the bpm whose whole note is the wait.
    No trace writes nothing; a wait of zero can't be written and gives null."""
    at_own = let(F.try_divide(F.lit(240.0), wait), lambda own: F.concat(decimal(own, 4), F.lit("#"), F.coalesce(fraction(trace * own / 240.0), decimal(trace, 6))))
    inner = F.when(F.abs(wait - 240.0 / bpm) < 0.005, written(trace, bpm)).otherwise(at_own)
    return F.when(trace > 0, F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.lit(""))
