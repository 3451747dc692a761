"""One-to-one matching of predicted and true events within a tolerance.

Predictions are taken in order of time; each takes the nearest true event of its key that is still free (of equally near
ones the later). A choice depends only on events of the same key that are linked by gaps within the tolerance, so a key is
cut into runs wherever neighbouring events are further apart, and each run is settled alone: a key with very many events
is spread over tasks, and runs of one event need no matching. Events at one time are one row with their numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.functions import notes as N
from metrolith.operators.scan import carry

SLACK = 1e-9


def events(frames: DataFrame, keys: tuple[str, ...] = ("chart",)) -> DataFrame:
    """keys, time_sec, key, place: a row for each note, with what must be equal for a match."""
    each = frames.select(*keys, "time_sec", F.posexplode("notes").alias("place", "n"))
    return each.select(*keys, "time_sec", N.match_key(F.col("n")).alias("key"), "place")


def instants(predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...], time: str = "time_sec") -> DataFrame:
    """keys, time, p, t: how many events of both sides there are at each time."""
    both = predicted.withColumn("side", F.lit(0)).unionByName(truth.withColumn("side", F.lit(1)))
    return both.groupBy(*keys, time).agg(F.count_if(F.col("side") == 0).alias("p"), F.count_if(F.col("side") == 1).alias("t"))


def runs(predicted: DataFrame, truth: DataFrame, keys: tuple[str, ...], tolerance: float, time: str = "time_sec", span: float | None = None) -> DataFrame:
    """instants() with `run`, the time at which the run of near events within keys begins. span: seconds of a key that one
    task takes (see scan.carry); None: a key is one task."""
    told = carry(instants(predicted, truth, keys, time), keys, time, span, last={"__before": F.col(time)})
    begins = F.coalesce(F.col(time) - F.col("__before") > tolerance + 2 * SLACK, F.lit(True))
    return carry(told, keys, time, span, last={"run": F.when(begins, F.col(time))}, inclusive=True).drop("__before")


def greedy(predicted: list[float], truth: list[float], tolerance: float) -> int:
    """Matches of one run; both sides ascending."""
    free, n = [True] * len(truth), 0
    low = 0
    for t in predicted:
        while low < len(truth) and truth[low] < t - tolerance - 2 * SLACK:
            low += 1
        best, nearest, i = -1, tolerance, low
        while i < len(truth) and truth[i] <= t + tolerance + 2 * SLACK:
            if free[i] and (away := abs(t - truth[i])) <= nearest + SLACK:
                best, nearest = i, away
            i += 1
        if best >= 0:
            free[best] = False
            n += 1
    return n


def counts(predicted: DataFrame, truth: DataFrame, groups: tuple[str, ...] = ("chart",), tolerance: float = 0.01, span: float | None = None) -> DataFrame:
    """groups, tp, n_predicted, n_true. Sides: groups, time_sec, key. A group that one side lacks counts zero there, and an
    event without a time matches nothing. span: as of runs().

    Runs that hold only one side, or one event of each, are counted without leaving the JVM."""
    keys = (*groups, "key")
    names = [*groups, "time_sec", "key"]
    told = runs(predicted.select(*names), truth.select(*names), keys, tolerance, span=span)
    sides = told.groupBy(*keys, "run").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.array_sort(F.collect_list(F.struct("time_sec", F.col("p").alias("np"), F.col("t").alias("nt")))).alias("all"))
    plain = F.when(F.col("run").isNull() | (F.col("p") == 0) | (F.col("t") == 0), F.lit(0)).when((F.col("p") == 1) & (F.col("t") == 1), F.lit(1))
    side = lambda n: F.flatten(F.transform("all", lambda s: F.array_repeat(s["time_sec"], s[n].cast("int"))))
    judged = sides.select(*groups, "p", "t", plain.alias("plain"), F.when(plain.isNull(), side("np")).alias("a"), F.when(plain.isNull(), side("nt")).alias("b"))
    schema = judged.select(*groups, "p", "t").schema.add("tp", "long")

    def run(batches):
        for batch in batches:
            data = batch.to_pydict()
            tp = [x if x is not None else greedy(a, b, tolerance) for x, a, b in zip(data["plain"], data["a"], data["b"], strict=True)]
            columns = [batch.column(i) for i in range(len(groups) + 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tp, pa.int64())], names=schema.fieldNames())

    found = judged.mapInArrow(run, schema)
    return found.groupBy(*groups).agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_predicted"), F.sum("t").alias("n_true"))


def scores(counts: DataFrame) -> DataFrame:
    """Micro-averaged precision, recall and F1 in per cent over all rows of counts."""
    s = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "n_predicted", "n_true")])
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    p, r = F.col("tp") / at_least("n_predicted"), F.col("tp") / at_least("n_true")
    f1: Column = F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))
    return s.select("tp", "n_predicted", "n_true", (p * 100).alias("precision"), (r * 100).alias("recall"), (f1 * 100).alias("f1"))
