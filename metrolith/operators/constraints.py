"""Temporal constraints: minimum gaps, cooldowns, nothing twice at one instant; whole groups with a violation are rejected.

Two forms. `conflicts` decides by windows over lanes and areas, without a state machine: up to a group's first violation
nothing has been refused yet, so it finds a violation exactly if the sequential rule does. `violations` lists all of them,
which needs the sequential rule, as refused notes leave no trace; it folds each group in one pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrolith.functions import durations as D
from metrolith.functions import notes as N
from metrolith.functions import vocabulary as V
from metrolith.functions.quantize import centiseconds
from metrolith.operators.scan import carry

VIOLATION = "rule string, time_sec double, place string"


def uses(frames: DataFrame, keys: tuple[str, ...] = ("chart", "level")) -> DataFrame:
    """A row for each lane pressed and area touched: keys, cs, kind, spot, until_cs (the end of a hold, else null)."""
    each = frames.select(*keys, centiseconds(F.col("time_sec")).alias("cs"), F.explode("notes").alias("n"))
    lane, n = N.press_lane(F.col("n")), F.col("n")
    held = F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), F.col("cs") + centiseconds(n["hold_sec"]))
    spot = F.coalesce(lane.cast("string"), n["area"])
    return each.select(*keys, "cs", F.when(n["area"].isNotNull(), "touch").otherwise("press").alias("kind"), spot.alias("spot"), held.alias("until_cs")).where("spot is not null")


def crowded(used: DataFrame, keys: tuple[str, ...], release: int = V.RELEASE_CS, gap: int = V.PRESS_GAP_CS) -> DataFrame:
    """Uses of a spot while it is taken, rests, or was used at the same instant. used: keys, cs, kind, spot, until_cs."""
    order = Window.partitionBy(*keys, "kind", "spot").orderBy("cs")
    earlier = order.rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*keys, "kind", "spot", "cs")
    told = used.withColumns({"taken": F.max("until_cs").over(earlier), "last": F.max("cs").over(earlier), "many": F.count("*").over(same)})
    pressed = (F.col("kind") == "press") & (F.col("cs") - F.col("last") < gap)
    return told.where((F.col("cs") <= F.col("taken") + release) | pressed | (F.col("many") > 1)).drop("taken", "last", "many")


def conflicts(frames: DataFrame, keys: tuple[str, ...] = ("chart", "level"), release: int = V.RELEASE_CS, gap: int = V.PRESS_GAP_CS, span: int | None = None) -> DataFrame:
    """The distinct keys that have at least one violation. frames: keys, time_sec, notes. span: centiseconds of a lane or area
    that one task takes (see scan.carry); None: a lane of a group is one task.

    Frames are read once: a row for each note, with what is wrong with its frame alone; then one for each spot and instant. A
    slide that presses nothing is a spot of its own, as it must only not stand twice at one instant."""
    notes, n = F.col("notes"), F.col("n")
    alone = ~N.frame_is_valid(notes) | ~F.forall(notes, N.durations_are_valid) | (centiseconds(F.col("time_sec")) < 0)
    each = D.worked_out(frames.select(*keys, "time_sec", "notes"), bad=alone, cs=centiseconds(F.col("time_sec"))).select(*keys, "bad", "cs", F.explode_outer("notes").alias("n"))
    lane = N.press_lane(n)
    kind = F.when(n["area"].isNotNull(), "touch").when(lane.isNotNull(), "press").otherwise("slide")
    spot = F.coalesce(lane.cast("string"), n["area"], F.when(n["type"] == "SLIDE", F.array_join(N.note_tokens(n), " ")))
    until = F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), F.col("cs") + centiseconds(n["hold_sec"]))
    used = each.select(*keys, "bad", "cs", kind.alias("kind"), spot.alias("spot"), until.alias("until_cs"))
    instants = used.groupBy(*keys, "kind", "spot", "cs").agg(F.bool_or("bad").alias("bad"), F.count("*").alias("many"), F.max("until_cs").alias("until_cs"))
    told = carry(instants, (*keys, "kind", "spot"), "cs", span, last={"last": F.col("cs")}, most={"taken": F.col("until_cs")})
    crowd = (F.col("cs") <= F.col("taken") + release) | (F.col("kind") == "press") & (F.col("cs") - F.col("last") < gap) | (F.col("many") > 1)
    return told.where(F.coalesce("bad", F.lit(True)) | F.col("spot").isNotNull() & crowd).select(*keys).distinct()


def accepted(frames: DataFrame, keys: tuple[str, ...] = ("chart", "level"), span: int | None = None) -> DataFrame:
    """The frames of all groups without a violation. span: as of conflicts()."""
    return frames.join(conflicts(frames, keys, span=span), list(keys), "left_anti")


class _State:
    """What has been used when, of one group."""

    def __init__(self):
        self.cs, self.texts, self.spots = None, set(), set()
        self.until: dict[str, int] = {}
        self.pressed: dict[str, int] = {}

    def frame(self, cs: int, notes: list[dict]) -> str | None:
        """Takes the notes in turn; the spot (or type) of the first that can't be, which ends the frame."""
        if cs != self.cs:
            self.cs, self.texts, self.spots = cs, set(), set()
        for n in notes:
            spot, held = n["spot"], n["until"]
            rests = spot in self.until and cs <= self.until[spot] + V.RELEASE_CS
            close = n["kind"] == "press" and spot in self.pressed and cs - self.pressed[spot] < V.PRESS_GAP_CS
            if not n["fits"] or n["text"] in self.texts or spot is not None and (spot in self.spots or rests or close):
                return spot or n["kind"]
            if spot is not None:
                self.spots.add(spot)
                if n["kind"] == "press":
                    self.pressed[spot] = cs
            if held is not None:
                self.until[spot] = cs + held
            self.texts.add(n["text"])
        return None


def violations(frames: DataFrame, keys: tuple[str, ...] = ("chart", "level"), span: float | None = None) -> DataFrame:
    """Every violation in order: keys, rule, time_sec, place. A frame counts once; what it refuses leaves no trace. span:
    seconds of a group that one task takes when runs are found (see scan.carry); None: a group is one task.

    Where all that was used before has come to rest, refused or not, nothing earlier matters: a group is cut into runs there
    and each run is folded on its own."""
    n_keys = len(keys)

    def fact(n):
        lane = N.press_lane(n)
        spot = F.coalesce(lane.cast("string"), n["area"])
        kind = F.when(n["area"].isNotNull(), "touch").when(lane.isNotNull(), "press").otherwise("slide")
        held = F.when(n["type"].isin("HOLD", "TOUCH_HOLD"), centiseconds(n["hold_sec"]))
        return F.struct(kind.alias("kind"), spot.alias("spot"), held.alias("until"), F.array_join(N.note_tokens(n), " ").alias("text"), N.durations_are_valid(n).alias("fits"))

    read = frames.select(*keys, "time_sec", centiseconds(F.col("time_sec")).alias("cs"), N.frame_is_valid(F.col("notes")).alias("ok"), F.transform("notes", fact).alias("facts"))
    held = F.array_max(F.transform("facts", lambda n: n["until"]))
    busy = F.greatest(F.col("cs") + (V.PRESS_GAP_CS - 1), F.col("cs") + held + V.RELEASE_CS)
    marked = carry(read, keys, "time_sec", span, most={"__busy": busy})
    begins = F.when(F.col("__busy").isNull() | (F.col("cs") > F.col("__busy")), F.col("time_sec"))
    runs = carry(marked, keys, "time_sec", span, last={"__run": begins}, inclusive=True).drop("__busy")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:n_keys]] + [VIOLATION])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        state, last, out = _State(), 0, []
        for row in sorted(table.to_pylist(), key=lambda r: r["time_sec"]):
            rule = place = None
            if row["cs"] < last:
                rule = "FRAME_TIME_BACKWARD"
            else:
                last = row["cs"]
                if not row["ok"]:
                    rule = "FRAME_TOKEN_INVALID"
                elif (place := state.frame(row["cs"], row["facts"])) is not None:
                    rule = "RESOURCE_CONFLICT"
            if rule:
                out.append((rule, row["time_sec"], place))
        names = [*keys, "rule", "time_sec", "place"]
        columns = [pa.array([k.as_py()] * len(out), k.type) for k in key[:n_keys]]
        columns += [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
        return pa.Table.from_arrays(columns, names=names)

    return runs.groupBy(*keys, "__run").applyInArrow(fold, schema)


def dense(events: DataFrame, keys: tuple[str, ...], span: int, most: int, time: str = "cs") -> DataFrame:
    """Events that are at least the `most`-th within the last `span` ticks of their group."""
    order = Window.partitionBy(*keys).orderBy(time).rangeBetween(-span, 0)
    return events.withColumn("within", F.count("*").over(order)).where(F.col("within") >= most)


def audit(frames: DataFrame, keys: tuple[str, ...] = ("chart", "level")) -> DataFrame:
    """What may be worth a look though it is allowed: keys, reason, n. Gaps of 30 to 50 ms on a lane, holds under 50 ms or
    over 10 s, five presses within 250 ms, nine within 500 ms."""
    used = uses(frames, keys)
    presses = used.where("kind = 'press'")
    gap = F.col("cs") - F.lag("cs").over(Window.partitionBy(*keys, "spot").orderBy("cs"))
    held = used.where("until_cs is not null").withColumn("length", F.col("until_cs") - F.col("cs"))
    found = [
        presses.withColumn("gap", gap).where("gap between 3 and 5").select(*keys, F.lit("near gap").alias("reason")),
        held.where("length < 5").select(*keys, F.lit("short hold")),
        held.where("length > 1000").select(*keys, F.lit("long hold")),
        dense(presses, keys, 24, 5).select(*keys, F.lit("five in 250 ms")),
        dense(presses, keys, 49, 9).select(*keys, F.lit("nine in 500 ms")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.groupBy(*keys, "reason").agg(F.count("*").alias("n"))

