"""Running values along the rows of a key, whatever share of all rows one key holds.

A window over a key sorts the key in one task. Here the key's rows are dealt to ranges of their order as well; each range is
reduced to a few numbers (the last values, the sums), these are carried along the ranges of a key, and every range goes on
from what is carried to it. A range is one task at most, and of a key a row for each range is seen by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrolith.sources.shared import cut


def carry(rows: DataFrame, keys: tuple[str, ...], order: str, span: float | None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, most: dict[str, Column] | None = None, inclusive: bool = False) -> DataFrame:
    """Adds for each name of `last` its newest value that isn't null, for each of `total` its sum, and for each of `most` its
    greatest value, over the rows of the same keys before this one (inclusive: with this one), in the order of a column
    without ties.

    span: the width of a range of `order`. rows are then computed once and checkpointed, as they are read twice. None: one
    window over each key, for keys that fit a task. Sums are of what comes before a range and of what comes before in it, so
    sums of fractions may differ in their last digits from those of one window. Rows without an order keep what a window
    gives them within their own range, null or zero otherwise."""
    last, total, most = last or {}, total or {}, most or {}
    upto = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    if span is None:
        own = upto(Window.partitionBy(*keys))
        return rows.withColumns({n: F.last(c, True).over(own) for n, c in last.items()} | {n: zero(F.sum(c).over(own)) for n, c in total.items()} | {n: F.max(c).over(own) for n, c in most.items()})
    names = [*last, *total, *most]
    valued = rows.withColumns({f"__v_{n}": c for n, c in (last | total | most).items()} | {"__range": F.floor(F.col(f"`{order}`") / span).cast("long")})
    valued = cut(valued)
    newest = lambda n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(f"`{order}`")))
    ends = valued.groupBy(*keys, "__range").agg(*[newest(n).alias(n) for n in last], *[F.sum(f"__v_{n}").alias(n) for n in total], *[F.max(f"__v_{n}").alias(n) for n in most])
    along = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(f"`{k}`").alias(f"__k_{k}") for k in (*keys, "__range")], *[F.last(n, True).over(along).alias(f"__c_{n}") for n in last], *[F.sum(n).over(along).alias(f"__c_{n}") for n in total], *[F.max(n).over(along).alias(f"__c_{n}") for n in most])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"__k_{k}")) for k in (*keys, "__range")])
    met = valued.join(carried, same, "left")
    own = upto(Window.partitionBy(*keys, "__range"))
    made = {n: F.coalesce(F.last(f"__v_{n}", True).over(own), F.col(f"__c_{n}")) for n in last}
    made |= {n: zero(F.col(f"__c_{n}")) + zero(F.sum(f"__v_{n}").over(own)) for n in total}
    made |= {n: F.greatest(F.max(f"__v_{n}").over(own), F.col(f"__c_{n}")) for n in most}
    return met.withColumns(made).drop("__range", *[f"__v_{n}" for n in names], *[f"__c_{n}" for n in names], *[f"__k_{k}" for k in (*keys, "__range")])
