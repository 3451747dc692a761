"""Times as centiseconds and tokens, rounded half to even as rint does; rotation of tokens. All as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrolith.functions import vocabulary as V
from metrolith.functions.durations import let


def centiseconds(seconds: Column) -> Column:
    return F.rint(seconds * 100).cast("long")


def time_token(seconds: Column) -> Column:
    """A positive time is at least one tick; times beyond the range stop at its ends."""
    raw = F.rint(seconds * 100)
    raw = F.when((seconds > 0) & (raw == 0), F.lit(1.0)).otherwise(raw)
    return (V.TS_BASE + F.greatest(F.lit(0.0), F.least(F.lit(float(V.TS_COUNT - 1)), raw))).cast("int")


def token_time(token: Column) -> Column:
    """Seconds of a time token, null for any other token."""
    return F.when(token.between(V.TS_BASE, V.TS_BASE + V.TS_COUNT - 1), (token - V.TS_BASE) / 100.0)


def rotate_token(token: Column, steps: Column) -> Column:
    """Lanes and the rings of touch areas turn by `steps` of eight; the centre and all other tokens stay."""
    turned = lambda base: base + F.pmod(token - base + steps, F.lit(8))
    out = F.when(token.between(V.LANE_BASE, V.LANE_BASE + 7), turned(V.LANE_BASE))
    for ring in (0, 8, 17, 25):
        out = out.when(token.between(V.TOUCH_BASE + ring, V.TOUCH_BASE + ring + 7), turned(V.TOUCH_BASE + ring))
    return out.otherwise(token).cast("int")


def rotate_tokens(tokens: Column, steps: Column) -> Column:
    return F.transform(tokens, lambda t: rotate_token(t, steps))


def fit(tokens: Column, length: int) -> Column:
    """Padded or cut to `length`."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(V.PAD), length)), 1, length)


def without_padding(tokens: Column) -> Column:
    """Without the zeros at the end."""
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t != V.PAD, i + 1).otherwise(0)))
    return F.slice(tokens, F.lit(1), F.coalesce(last, F.lit(0)))


def time_of_each(tokens: Column) -> Column:
    """For each place the last time token up to there, null before the first. Each time token is repeated up to the next."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("token"), i.alias("place")))
    times = F.filter(placed, lambda s: s["token"].between(V.TS_BASE, V.TS_BASE + V.TS_COUNT - 1))

    def spread(known: Column) -> Column:
        behind = lambda i: F.coalesce(F.get(known["times"], i)["place"], known["n"])
        none = F.array_repeat(F.lit(None).cast("int"), behind(F.lit(0)))
        return F.concat(none, F.flatten(F.transform(known["times"], lambda s, i: F.array_repeat(s["token"], behind(i + 1) - s["place"]))))

    return let(F.struct(times.alias("times"), F.size(tokens).alias("n")), spread)


def up_to_last_frame(tokens: Column) -> Column:
    """Cut behind the last end of a frame: what a decoder that stopped early leaves whole."""
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t == V.FRAME_END, i + 1).otherwise(0)))
    return F.slice(tokens, F.lit(1), F.coalesce(last, F.lit(0)))


def ended(tokens: Column, prefix: Column, reason: Column) -> Column:
    """A decoded sequence as it is kept: tokens, raw_new_tokens, new_tokens, dropped_tokens. tokens: what was decoded behind
    `prefix` given ones, with its end mark if it came to one. Where the budget ran out or the grammar allowed nothing more, what
    is behind the last whole frame goes (without any, all that is new) and an end mark is put there."""
    last = F.array_max(F.transform(tokens, lambda t, i: F.when(t == V.FRAME_END, i + 1).otherwise(0)))

    def kept(v: Column) -> Column:
        broken = reason.isin("token_budget", "grammar_dead_end") & (F.element_at(tokens, -1) != V.EOS)
        own = F.when(broken, F.concat(F.slice(tokens, F.lit(1), v["upto"]), F.array(F.lit(V.EOS)))).otherwise(tokens)
        dropped = F.when(broken, F.size(tokens) - v["upto"]).otherwise(0)
        return F.struct(own.alias("tokens"), (F.size(tokens) - prefix).alias("raw_new_tokens"), (F.size(own) - prefix).alias("new_tokens"), dropped.alias("dropped_tokens"))

    return let(F.struct(let(last, lambda n: F.when(n > 0, n).otherwise(prefix)).alias("upto")), kept)
