"""Periodic runs of words, by factors, crossing runs and copies (the linear-time scheme of Kolpakov and Kucherov).

A run is a stretch of words with smallest period q, at least `exponent` periods and `least` words long, that no neighbouring
word extends. In such a run a word occurs `exponent` times and two words side by side `exponent` - 1 times, so a text falls
apart, without loss, at pairs that are rarer in it. Of each stretch that remains:

1. a suffix automaton with the first end of each state gives the factors: the longest piece that began earlier, or a new word;
2. a run that touches a border between factors reaches less than a period beyond the factor before it (else that factor
   would have been longer), so common extensions to both sides of each border find all of them in windows whose sizes add up
   to a multiple of the text (Main);
3. any other run lies inside a factor, and stands inside the factor's earlier occurrence too: it is copied from there.

Work and memory grow linearly with a text; a text is one row and never leaves its task.

Defined results: a null text counts as empty (no words, no runs); repeated rows and ids are searched row by row; of equal
stretches with several periods the smallest counts; an empty table gives an empty table; other columns are dropped unless
named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text behind one batch of results.
BATCH_CHARS = 2_000_000

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, where the same piece began earlier; -1 for a new word) of each factor."""
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]  # first: the smallest end of the state's strings
    last = 0
    for end, word in enumerate(w):
        state = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(end)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = state
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if size[q] > size[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                link[q] = twin
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = twin
                    p = link[p]
                q = twin
            link[state] = q
        last = state
    out, at, n = [], 0, len(w)
    while at < n:
        state, end = 0, at
        while end < n and first[ahead := step[state][w[end]]] < end:
            state, end = ahead, end + 1
        out.append((at, end - at, first[state] - (end - at) + 1) if end > at else (at, 1, -1))
        at = max(end, at + 1)
    return out


def extensions(w: list[int]) -> list[int]:
    """For each place, how far the text from there agrees with the text from the beginning; for place 0, all of it."""
    n = len(w)
    out = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def touching(w: list[int], b: int, before: int, after: int, least: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of each run that touches the border b and ends in the factor of `after` words behind it, or at b;
    a factor of `before` words ends at b."""
    most = (before + after) // (exponent - 1) + 1
    reach = min(b, before + most + 1)
    t, u = w[b - reach : b], w[b : b + after]
    back_t, back = t[::-1], (t + u)[::-1]
    ahead_u = extensions(u)  # u against u from q on
    behind_t = extensions(back_t)  # t against t up to q before its end
    behind_u = extensions([*back_t, -1, *back])[reach + 1 :]  # t against what ends q behind the border
    ahead_t = extensions([*u, -1, *t, *u])[after + 1 :]  # u against what begins q before the border
    for q in range(1, most + 1):
        found = []
        if q <= after:
            found.append((b - behind_u[after - q], b + q + (ahead_u[q] if q < after else 0)))
        if q <= reach:
            found.append((b - q - (behind_t[q] if q < reach else 0), b + min(ahead_t[reach - q], after)))
        for s, e in found:
            if e - s < max(least, exponent * q):
                continue
            if e < len(w) and w[e] == w[e - q] or s and w[s - 1] == w[s - 1 + q]:
                continue  # it goes on behind this factor, and is found there
            yield s, e, q


def runs_of(w: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and then end."""
    if not w:
        return []
    parts = factors(w)
    period: dict[tuple[int, int], int] = {}
    for (_, before, _), (b, after, _) in zip(parts, [*parts[1:], (len(w), 0, -1)], strict=True):
        for s, e, q in touching(w, b, before, after, least, exponent):
            period[s, e] = min(q, period.get((s, e), q))
    at: dict[int, list[tuple[int, int]]] = {}
    for s, e in sorted(period):
        at.setdefault(s, []).append((e, period[s, e]))
    for b, size, source in parts:
        if source < 0 or size < least + 2:
            continue
        shift, limit = b - source, source + size
        for s in range(source + 1, limit - least):  # from left to right: a factor may overlap its earlier occurrence
            if s not in at:
                continue
            inside = []
            for e, q in at[s]:
                if e >= limit:
                    break
                inside.append((e + shift, q))
            if inside:
                at[s + shift] = inside + at.get(s + shift, [])  # those that touch a border are longer
    return [(s, e, q) for s in sorted(at) for e, q in at[s]]


def stretches(ids: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest stretches all of whose pairs of neighbours are frequent enough to lie in a run."""
    often = np.bincount(ids) >= exponent
    both = np.flatnonzero(often[ids[:-1]] & often[ids[1:]])
    if len(both) < least - 1:
        return
    _, of, count = np.unique(ids[both] * (int(ids.max()) + 1) + ids[both + 1], return_inverse=True, return_counts=True)
    good = np.zeros(len(ids) + 1, dtype=np.int8)
    good[both[count[of] >= exponent - 1] + 1] = 1
    turns = np.flatnonzero(np.diff(good))  # good[i + 1]: the pair of words i and i + 1
    for s, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        if e + 1 - s >= least:
            yield s, e + 1


def search(words: list[bytes], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    found = []
    for begin, end in stretches(ids, least, exponent):
        found += [(begin + s, e - s, q) for s, e, q in runs_of(ids[begin:end].tolist(), least, exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t.as_py() or "")
        chars += len(block[-1])
        if chars >= BATCH_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 6, exponent: int = 4) -> DataFrame:
    """`keep`, n_words, runs array<struct<start, length, period>> by start and then period, collapsed (the text without what
    runs repeat, words joined by one space). Words are what stands between ASCII white space. exponent: 2 or more."""
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    more = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN, False)), ("collapsed", T.StringType())]
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t, False) for n, t in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(batch.num_columns - 1)):
                n_words, found, left = [], [], []
                for t in block:
                    words = t.encode().split()  # of bytes, so at ASCII white space only
                    found.append(search(words, least, exponent))
                    left.append(collapse(words, found[-1]).decode())
                    n_words.append(len(words))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.array([r for x in found for r in x], dtype=np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.fieldNames())
                arrays = [batch.column(i).slice(at, len(block)) for i in range(batch.num_columns - 1)]
                arrays += [pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(left, pa.string())]
                at += len(block)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(run, schema)
