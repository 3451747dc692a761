"""Substring dedup: removes words covered by a window of 35 words that stands anywhere else, found by difference covers.

A difference cover D modulo v meets every difference of two positions: for any two places there is a shift below v that
moves both onto positions in D. So windows of `anchor` = window - v + 1 words are hashed at cover positions only, and two
equal windows always share an aligned anchor. Windows around a repeated anchor are then extended to their full length and
compared by 96-bit hashes over all blocks.

Defined results: null and empty texts have no words (kept_sha256 of nothing); a text shorter than the window loses
nothing; repeated rows are documents of their own, so they remove each other; a null id is a document like any other;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metrolith.llm import blocks as B

#: A perfect difference set modulo 21: every difference occurs.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


class Words:
    """The words of a slice of documents as 64-bit codes in two lanes or one, and where each document's words start."""

    def __init__(self, part: B.Slice, space: np.ndarray = SPACE, lanes: int = 2):
        text = part.data
        gap = space[text]
        begins = ~gap
        begins[1:] &= gap[:-1]
        inner = part.starts[1:-1]
        inner = inner[inner < len(text)]
        begins[inner] = ~gap[inner]  # a document's first byte starts a word even if the document before ends in one
        self.begin = np.flatnonzero(begins)
        ends = ~gap
        ends[:-1] &= gap[1:]
        last = part.starts[1:] - 1
        last = last[last >= 0]
        ends[last] = ~gap[last]
        self.end = np.flatnonzero(ends) + 1
        self.codes = [B.Sums(B.BYTE_CODES[lane][text], lane).of(self.begin, self.end) for lane in range(lanes)]
        self.starts = np.searchsorted(self.begin, part.starts)
        self.kept: dict[int, B.Sums] = {}

    def sums(self, lane: int) -> B.Sums:
        if lane not in self.kept:
            self.kept[lane] = B.Sums(self.codes[lane], lane)
        return self.kept[lane]

    def windows(self, length: int) -> np.ndarray:
        """Which words start a full stretch of `length` within their document."""
        n = len(self.begin)
        doc_end = np.repeat(self.starts[1:], np.diff(self.starts))
        return np.arange(n) + length <= doc_end


def _cover(words: Words, anchor: int) -> np.ndarray:
    place = np.arange(len(words.begin)) - np.repeat(words.starts[:-1], np.diff(words.starts))
    return np.isin(place % PERIOD, COVER) & words.windows(anchor)


def _anchors(words: Words, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(_cover(words, anchor))
    return at, words.sums(0).of(at, at + anchor)


WIDE = np.dtype([("h", np.uint64), ("g", np.uint32)])


def _wide(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """96-bit hashes of the windows at `at`."""
    out = np.empty(len(at), dtype=WIDE)
    out["h"] = words.sums(0).of(at, at + window)
    out["g"] = words.sums(1).of(at, at + window) >> np.uint64(32)
    return out


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 96-bit hashes, each once; how often each occurs; and which of them each value is."""
    order = np.lexsort((values["g"], values["h"]))
    ranked = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (ranked["h"][1:] != ranked["h"][:-1]) | (ranked["g"][1:] != ranked["g"][:-1])
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], np.diff(np.append(np.flatnonzero(new), len(values))), which


def _candidates(words: Words, at: np.ndarray, hashes: np.ndarray, repeated: np.ndarray, anchor: int, window: int) -> np.ndarray:
    """Starts of full windows that hold a repeated anchor."""
    n = len(words.begin)
    sums = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.bincount(at[B.found(hashes, repeated)], minlength=n)[:n], out=sums[1:])
    starts = np.flatnonzero(words.windows(window))
    return starts[sums[starts + window - anchor + 1] > sums[starts]]


class _Block:
    """The slices of a block with their words, anchors and, once the answers are known, candidate windows."""

    def __init__(self, docs: pa.Table, window: int):
        self.window, self.anchor = window, window - PERIOD + 1
        self.slices = list(B.slices(docs))
        self.words = [Words(s) for s in self.slices]
        self.anchors = [_anchors(w, self.anchor) for w in self.words]
        every = np.concatenate([h for _, h in self.anchors]) if self.anchors else np.zeros(0, np.uint64)
        self.once, count = np.unique(every, return_counts=True)
        self.more = count > 1

    def look(self, replies: pa.Table, n: int) -> None:
        repeated = self.once[self.more | B.told(self.once, B.reply_of(replies, 1), n)]
        self.starts = [_candidates(w, *a, repeated, self.anchor, self.window) for w, a in zip(self.words, self.anchors, strict=True)]
        every = [_wide(w, at, self.window) for w, at in zip(self.words, self.starts, strict=True)]
        self.windows, self.count, self.which = _grouped(np.concatenate(every) if every else np.zeros(0, WIDE))


def remove_repeats(df: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD}")

    def first(block: int, docs: pa.Table, n: int) -> pa.Table:
        return B.offer_hashes(_Block(docs, window).once, block, n)

    def second(block: int, docs: pa.Table, replies: pa.Table, n: int) -> pa.Table:
        own = _Block(docs, window)
        own.look(replies, n)
        h, g = own.windows["h"], own.windows["g"]
        return B.offers([(b, block, [B.packed_ascending(h[p]), g[p].tobytes()]) for b, p in B.deal(h, n)])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        given = []
        for r in rows:
            given.append(np.empty(len(r["p1"]) // 4, dtype=WIDE))
            given[-1]["h"], given[-1]["g"] = B.unpacked_ascending(r["p0"]), np.frombuffer(r["p1"], dtype=np.uint32)
        _, count, which = _grouped(np.concatenate(given))
        parts = np.split(count[which] > 1, np.cumsum([len(g) for g in given])[:-1])
        return B.replies([(r["block"], 2, r["bucket"], np.packbits(p).tobytes()) for r, p in zip(rows, parts, strict=True)])

    def last(block: int, docs: pa.Table, replies: pa.Table, n: int) -> pa.Table:
        own = _Block(docs, window)
        own.look(replies, n)
        twice = ((own.count > 1) | B.told(own.windows["h"], B.reply_of(replies, 2), n))[own.which]
        rows, done = [], 0
        for s, words, at in zip(own.slices, own.words, own.starts, strict=True):
            hit = at[twice[done : done + len(at)]]
            done += len(at)
            edge = np.zeros(len(words.begin) + 1, dtype=np.int64)
            edge[hit] += 1
            np.subtract.at(edge, hit + window, 1)
            keep = np.cumsum(edge)[:-1] == 0
            data = s.data.tobytes()
            for i, id_ in enumerate(s.ids.tolist()):
                mine = data[s.starts[i] : s.starts[i + 1]].split()  # exactly at the six separating bytes
                kept = keep[words.starts[i] : words.starts[i + 1]]
                gone = len(mine) - int(kept.sum())
                rows.append((None if id_ == B.NO_ID else id_, len(mine), gone, hashlib.sha256(b" ".join(compress(mine, kept.tolist()) if gone else mine)).hexdigest()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=SCHEMA.fieldNames())

    return B.run(df, key, text, SCHEMA, first, B.answer_hashes(1), second, answer, last)
