"""Suffix-array dedup: removes bytes covered by a 50-byte string that also starts in a document with a smaller id.

Bounded interval expansion on a Burrows-Wheeler transform: the suffixes of a bucket are sorted once; then the intervals
of suffixes with a common prefix of 1, 2, 3 .. bytes are derived breadth-first, each from the ones before by extending
them backward through the transform, and expansion stops at the minimum length. Suffixes that still share an interval
there share that string, and the smallest id of the interval decides.

Only text around repeated anchors gets that far. The anchor of a 50-byte window is the smallest hash of its 20-byte
substrings, so equal windows have equal anchors, and a bucket of anchors has all occurrences of the windows it stands
for. Windows of one anchor that follow each other travel as one context; a block sends each of its contexts once, with
the smallest id that holds it.

Defined results: null and empty texts have no bytes; texts shorter than the minimum lose nothing; equal ids are not
smaller than each other, so repeated rows only lose what a smaller id holds; a null id comes after all others; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from metrolith.llm import blocks as B

#: Bytes of an anchor, and windows that one context holds at most.
ANCHOR, RUN = 20, 48
#: Symbols in one suffix array, unless a single anchor has more.
SYMBOLS = 400_000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
LAST = np.uint64(2**64 - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` values that follow each other."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class Runs:
    """Runs of windows with the same anchor in a slice: start and end of each run's windows, its anchor and its document."""

    def __init__(self, part: B.Slice, minimum: int):
        self.begin = self.end = self.doc = np.zeros(0, dtype=np.int64)
        self.anchor = np.zeros(0, dtype=np.uint64)
        windows = np.maximum(np.diff(part.starts) - minimum + 1, 0)  # of each document
        total = int(windows.sum())
        if not total:
            return
        anchor = _sliding_min(B.Sums(B.BYTE_CODES[0][part.data]).runs(ANCHOR), minimum - ANCHOR + 1)
        doc = np.repeat(np.arange(len(windows)), windows)
        at = np.arange(total) + np.repeat(part.starts[:-1] - (np.cumsum(windows) - windows), windows)
        own = anchor[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        parts = -(-length // RUN)  # a long run is cut; each window stays whole
        piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(begin, parts) + piece * RUN
        stop = np.minimum(start + RUN, np.repeat(begin + length, parts))
        self.begin, self.end = at[start], at[start] + (stop - start)
        self.anchor, self.doc = B.mix(own[start]), doc[start]  # smallest hashes lie close together; mixed, they spread over buckets


class _Block:
    def __init__(self, docs: pa.Table, minimum: int):
        self.minimum = minimum
        self.slices = list(B.slices(docs))
        self.runs = [Runs(s, minimum) for s in self.slices]
        every = [np.zeros(0, np.uint64)]
        for r in self.runs:  # each anchor once for each document
            order = np.lexsort((r.doc, r.anchor))
            a, d = r.anchor[order], r.doc[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            every.append(a[new])
        self.once, count = np.unique(np.concatenate(every), return_counts=True)
        self.more = count > 1

    def look(self, replies: pa.Table, n: int) -> None:
        """The contexts around repeated anchors, each once with its anchor and its smallest id, in order of first sight."""
        repeated = self.once[self.more | B.told(self.once, B.reply_of(replies, 1), n)]
        known: dict[bytes, int] = {}
        anchors, ids, self.used, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], self.minimum - 1
        for s, r in zip(self.slices, self.runs, strict=True):
            picked = np.flatnonzero(B.found(r.anchor, repeated))
            data, which, fresh = s.data.tobytes(), [], []
            for i, begin, end in zip(picked.tolist(), r.begin[picked].tolist(), (r.end[picked] + more).tolist(), strict=True):
                context = data[begin:end]
                at = known.get(context)
                if at is None:
                    at = known[context] = len(known)
                    fresh.append(i)
                which.append(at)
            anchors.append(r.anchor[fresh])
            ids.append(s.ids[r.doc[fresh]])  # documents come by id, so this is the smallest
            self.used.append((picked, np.array(which, dtype=np.int64)))
        self.anchor_of, self.id_of = np.concatenate(anchors), np.concatenate(ids)
        self.contexts = list(known)


def common_prefixes(texts: list[bytes], minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, group) of every place where `minimum` bytes of a text start; equal strings have equal groups."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(size + 1) - (size + 1)
    n = int((size + 1).sum())
    owner = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(owner)) + owner
    symbol = np.zeros(n, dtype=np.uint16)  # 0 ends a text
    symbol[place] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint16) + 1
    # Suffix array: by seven symbols at first, then what is still equal by twice as many each time; in the end the text
    # decides, as if each text ended in a symbol of its own.
    text_of = np.repeat(np.arange(len(texts)), size + 1)
    final = start + size
    key, ended = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for k in range(7):
        piece = np.zeros(n, dtype=np.int64)
        piece[: n - k] = symbol[k:]
        piece[ended] = 0
        ended |= piece == 0
        key = key << 9 | piece
    order = np.argsort(key, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the first place of those that are equal
    width, longest = 7, int(size.max()) + 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        which = order[places]
        after = which + width
        inside = (after <= final[text_of[which]]) & (width < longest)
        second = np.where(inside, rank[np.minimum(after, n - 1)] + len(texts), text_of[which])
        sub = np.lexsort((second, rank[which]))
        which, second = which[sub], second[sub]
        fresh = np.ones(len(which), dtype=bool)
        fresh[1:] = (rank[which][1:] != rank[which][:-1]) | (second[1:] != second[:-1])
        order[places] = which
        new[places] = fresh
        rank[which] = np.maximum.accumulate(np.where(fresh, places, 0))
        width *= 2
    # Transform, and from it the step back: rank r of a suffix -> rank of the suffix one symbol shorter.
    transform = symbol[order - 1]
    back = np.argsort(transform, kind="stable").astype(np.int32)
    first = symbol[order]
    edge = np.ones(n, dtype=bool)
    edge[1:] = first[1:] != first[:-1]
    letter_edge = edge.copy()
    for _ in range(minimum - 1):
        interval = np.cumsum(edge, dtype=np.int32)  # of each suffix, for the length reached
        stepped = interval[back]
        edge = letter_edge.copy()
        edge[1:] |= stepped[1:] != stepped[:-1]
    group = np.empty(n, dtype=np.int64)
    group[order] = np.cumsum(edge)
    whole = np.arange(n) + minimum <= final[text_of]
    at = np.flatnonzero(whole)
    return text_of[at], at - start[text_of[at]], group[at]


class Smallest:
    """The smallest id that has the same string, for each window of each context."""

    def __init__(self, contexts: list[bytes], anchors: np.ndarray, ids: np.ndarray, minimum: int):
        known: dict[bytes, int] = {}
        self.which = np.fromiter((known.setdefault(c, len(known)) for c in contexts), dtype=np.int64, count=len(contexts))
        texts = list(known)
        own = np.full(len(texts), B.NO_ID, dtype=np.int64)
        np.minimum.at(own, self.which, ids)
        anchor = np.zeros(len(texts), dtype=anchors.dtype)
        anchor[self.which] = anchors
        long = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.size = long - minimum + 1
        self.begin = np.cumsum(self.size) - self.size
        self.least = np.repeat(own, self.size)
        order = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])) if len(order) else np.zeros(0, np.int64)
        # Contexts of one anchor stay together, and only so many symbols are sorted at a time.
        part: list[int] = []
        symbols = 0
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            if b - a > 1:  # an anchor with one context has no other string to meet
                part += order[a:b].tolist()
                symbols += int(long[order[a:b]].sum())
            if part and (symbols >= SYMBOLS or b == len(order)):
                at = np.array(part, dtype=np.int64)
                text, place, group = common_prefixes([texts[i] for i in part], minimum)
                smallest = np.full(int(group.max()) + 1, B.NO_ID, dtype=np.int64)
                np.minimum.at(smallest, group, own[at[text]])
                self.least[self.begin[at[text]] + place] = smallest[group]
                part, symbols = [], 0

    def of(self, begin: int, end: int) -> np.ndarray:
        """For all windows of contexts[begin:end], in a row."""
        which = self.which[begin:end]
        return self.least[_stretches(self.begin[which], self.size[which])]


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 .. for `size` places, for each of them in turn."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def remove_repeats(df: DataFrame, minimum: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    if not ANCHOR <= minimum <= 200:
        raise ValueError(f"minimum must be {ANCHOR} to 200")  # the size of a context is sent as one byte

    def first(block: int, docs: pa.Table, n: int) -> pa.Table:
        return B.offer_hashes(_Block(docs, minimum).once, block, n)

    def second(block: int, docs: pa.Table, replies: pa.Table, n: int) -> pa.Table:
        own = _Block(docs, minimum)
        own.look(replies, n)
        rows = []
        for b, p in B.deal(own.anchor_of, n):
            texts = [own.contexts[i] for i in p.tolist()]
            size = np.array([len(t) for t in texts], dtype=np.uint8)
            rows.append((b, block, [B.packed(b"".join(texts)), size.tobytes(), own.anchor_of[p].astype(np.uint32).tobytes(), B.packed(np.diff(own.id_of[p], prepend=0).tobytes())]))
        return B.offers(rows)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts, anchors, ids, counts = [], [], [], []
        for r in rows:
            text, at = B.unpacked(r["p0"]), 0
            for k in r["p1"]:
                contexts.append(text[at : at + k])
                at += k
            counts.append(len(r["p1"]))
            anchors.append(np.frombuffer(r["p2"], dtype=np.uint32))
            ids.append(np.cumsum(np.frombuffer(B.unpacked(r["p3"]), dtype=np.int64)))
        smallest = Smallest(contexts, np.concatenate(anchors), np.concatenate(ids), minimum)
        ends = np.cumsum(counts).tolist()
        return B.replies([(r["block"], 2, r["bucket"], B.packed(smallest.of(b - k, b).tobytes())) for r, k, b in zip(rows, counts, ends, strict=True)])

    def last(block: int, docs: pa.Table, replies: pa.Table, n: int) -> pa.Table:
        own = _Block(docs, minimum)
        own.look(replies, n)
        size = np.array([len(c) - minimum + 1 for c in own.contexts], dtype=np.int64)
        begin = np.cumsum(size) - size
        least = np.empty(int(size.sum()), dtype=np.int64)
        answers = B.reply_of(replies, 2)
        for b, p in B.deal(own.anchor_of, n):
            least[_stretches(begin[p], size[p])] = np.frombuffer(B.unpacked(answers[b]), dtype=np.int64)
        rows = []
        for s, r, (picked, which) in zip(own.slices, own.runs, own.used, strict=True):
            many = size[which]
            smaller = least[_stretches(begin[which], many)] < np.repeat(s.ids[r.doc[picked]], many)
            hit = _stretches(r.begin[picked], many)[smaller]
            edge = np.zeros(len(s.data) + 1, dtype=np.int64)
            edge[hit] += 1
            np.subtract.at(edge, hit + minimum, 1)
            gone = np.cumsum(edge)[:-1] > 0
            for i, id_ in enumerate(s.ids.tolist()):
                a, b = s.starts[i], s.starts[i + 1]
                mine = gone[a:b]
                n_gone = int(mine.sum())
                spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n_gone else 0
                kept = s.data[a:b][~mine] if n_gone else s.data[a:b]
                rows.append((None if id_ == B.NO_ID else id_, int(b - a), n_gone, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=SCHEMA.fieldNames())

    return B.run(df, key, text, SCHEMA, first, B.answer_hashes(1), second, answer, last)
