"""Streams of events: window membership as they arrive, and the sequential form of window-by-window generation.

`members` is stateless, so a stream is planned like a table. `generate` keeps, for each song, only the frames that the next
window can see; each arriving window is answered from that state and from its own features. This is an extension: it lets
the batch operators run on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metrolith.operators import windows


def members(events: DataFrame, w: windows.Windows = windows.Windows(), time: str = "time_sec") -> DataFrame:
    return windows.members(events, w, time)


def counted(events: DataFrame, stamp: str, keys: tuple[str, ...], span: str, late: str) -> DataFrame:
    """keys, window, n: events per tumbling window; rows later than the watermark are dropped, as Spark does."""
    return events.withWatermark(stamp, late).groupBy(*keys, F.window(stamp, span)).agg(F.count("*").alias("n"))


def generate(arriving: DataFrame, model: Callable[[list[float], str, int], list[float]], w: windows.Windows = windows.Windows(stride=10.0)) -> DataFrame:
    """chart, k, time_sec: for each arriving window (chart, k, payload), in order of k within a batch, what
    model(context times, payload, k) commits. Times are centiseconds of the song; the context is what was committed in the
    seconds before the target, and a time outside the window's own target isn't committed. A window that comes after a
    later one has been answered is answered with the context that is left."""
    context, span = round((w.target_start - w.prefix_start) * 100), round((w.target_end - w.target_start) * 100)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: list[int] = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values("k")
        out = []
        for k, payload in zip(rows["k"], rows["payload"], strict=True):
            start = int(k) * span
            seen = [t for t in kept if start - context <= t < start]
            made = sorted(t for t in model(seen, payload, int(k)) if start <= t < start + span)
            out += [(key[0], int(k), int(t)) for t in made]
            kept = [t for t in kept + made if t >= start + span - context]
        state.update((kept,))
        yield pd.DataFrame(out, columns=["chart", "k", "time_cs"])

    return arriving.groupBy("chart").applyInPandasWithState(step, "chart string, k long, time_cs long", "kept array<long>", "append", GroupStateTimeout.NoTimeout)
