"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Inside one pre-token, the encoding of a prefix ends in the one token t whose seam with the last token of the prefix
before it stays open under all merges; so count[i] = count[i - len(t)] + 1 and the table of a pre-token holds the exact
count of each of its byte prefixes. The tokens that a prefix can end in are read off an automaton, whose state is the
longest end of the prefix that begins some token; its steps are worked out when they first occur. Counts at pre-token
borders add up. A truncation or budget question is then a look-up in running sums, without encoding again.

Defined results: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty table; repeated rows are
counted row by row; other columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokens, token seams and steps whose results a worker keeps, and the letters of the longest pre-token that it keeps.
KEPT, LONGEST_KEPT = 600_000, 100


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Token counts by the merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.id = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]):
            a, b = raw(a), raw(b)
            self.rank[self.id[a], self.id[b]] = n, self.id[a + b]
        #: Of each token, the tokens along its left and right edge with the rank at which each is swallowed.
        self.left_edge: dict[int, list[tuple[int, float]]] = {}
        self.right_edge: dict[int, list[tuple[int, float]]] = {}
        never = float("inf")
        for token in self.id.values():
            self.left_edge[token] = self.right_edge[token] = [(token, never)]
        whole = {}
        for (a, b), (n, made) in self.rank.items():  # merges come in rank order, so the parts are complete
            if made in whole:
                continue
            whole[made] = n
            self.left_edge[made] = [(made, never), (a, n), *self.left_edge[a][1:]]
            self.right_edge[made] = [(made, never), (b, n), *self.right_edge[b][1:]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(pattern).findall
        self.tables: dict[str, bytes | tuple] = {}
        self.seams: dict[int, bool] = {}
        #: Tokens that the merges never produce from their own bytes can't end a prefix.
        self.unmade = {t for raw_bytes, t in self.id.items() if self.plain(raw_bytes) != [t]}
        self.begun = {token[:n] for token in self.id for n in range(len(token) + 1)}
        #: Of each state, its bytes and the tokens that end there with their sizes, longest first.
        self.states: dict[bytes, int] = {b"": 0}
        self.held: list[bytes] = [b""]
        self.endings: list[tuple[tuple[int, int], ...]] = [()]
        self.steps: dict[int, int] = {}

    def plain(self, data: bytes) -> list[int]:
        """Encoding by the definition: lowest rank first, leftmost first."""
        ids = [self.id[data[i : i + 1]] for i in range(len(data))]
        none = (len(self.rank), -1)
        while len(ids) > 1:
            (n, made), at = min((self.rank.get((ids[i], ids[i + 1]), none), i) for i in range(len(ids) - 1))
            if made < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def open_seam(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses from token `left` into token `right` that follows it."""
        key = left << 20 | right
        if (known := self.seams.get(key)) is not None:
            return known
        rank, seam = self.rank, True
        for a, a_until in self.right_edge[left]:
            for b, b_until in self.left_edge[right]:
                found = rank.get((a, b))
                if found is not None and found[0] < a_until and found[0] <= b_until:
                    seam = False  # both edges stand when this merge's turn comes; of equal ranks the left one goes first
                    break
            if not seam:
                break
        if len(self.seams) > KEPT:
            self.seams.clear()
        self.seams[key] = seam
        return seam

    def step(self, state: int, byte: int) -> int:
        """The state behind one more byte."""
        held = self.held[state] + bytes((byte,))
        while held not in self.begun:
            held = held[1:]
        to = self.states.get(held)
        if to is None:
            to = self.states[held] = len(self.held)
            ends = ((self.id.get(held[i:]), len(held) - i) for i in range(len(held)))
            self.held.append(held)
            self.endings.append(tuple((t, n) for t, n in ends if t is not None and t not in self.unmade))
        if len(self.steps) > KEPT:
            self.steps.clear()
        self.steps[state << 8 | byte] = to
        return to

    def table(self, piece: str) -> bytes | tuple:
        """count[i] for i = 1 .. bytes of the piece."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        steps, endings, seams = self.steps.get, self.endings, self.seams.get
        count, last, state = [0], [-1], 0
        for end, byte in enumerate(piece.encode(), 1):
            to = steps(state << 8 | byte)
            state = self.step(state, byte) if to is None else to
            for token, size in endings[state]:
                begin = end - size
                if begin:
                    seam = seams(last[begin] << 20 | token)
                    if not (self.open_seam(last[begin], token) if seam is None else seam):
                        continue
                count.append(count[begin] + 1)
                last.append(token)
                break
        out = bytes(count[1:]) if count[-1] < 256 else tuple(count[1:])
        if len(self.tables) > KEPT:
            self.tables.clear()
        if len(piece) <= LONGEST_KEPT:  # so the store is bounded in bytes too
            self.tables[piece] = out
        return out

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """(pre-token or special string, its tokens)."""
        pos = 0
        for m in self.cut.finditer(text) if self.cut else ():
            for p in self.split(text[pos : m.start()]):
                yield p, self.table(p)[-1]
            yield m.group(), 1
            pos = m.end()
        for p in self.split(text[pos:] if pos else text):
            yield p, self.table(p)[-1]

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        """The pre-tokens and the tokens of each."""
        if self.cut and self.cut.search(text):
            both = list(self.parts(text))
            return [p for p, _ in both], [n for _, n in both]
        pieces, get, table = self.split(text), self.tables.get, self.table
        return pieces, [(get(p) or table(p))[-1] for p in pieces]

    def prefix(self, text: str, chars: int) -> int:
        """Tokens of text[:chars]: running counts up to the pre-token before the cut, and the cut's own pre-tokens by table.

        A cut may change how the last two pre-tokens are split, so these are split again; what is before stays as it is."""
        pieces, counts = self.counts(text)
        ends = list(accumulate(map(len, pieces)))
        safe = max(0, bisect_right(ends, chars) - 2)
        begin = ends[safe - 1] if safe else 0
        return sum(counts[:safe]) + sum(self.counts(text[begin:chars])[1])


_COUNTERS: dict[tuple[str, str], PrefixCounter] = {}


def count_tokens(df: DataFrame, path: str, pattern: str, budget: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_prefixes: bool = False) -> DataFrame:
    """`keep`, n_bytes, n_tokens, over_limit (more than `budget` tokens), fit_chars (code points up to the last pre-token
    that ends within the budget); with_prefixes adds prefix_chars and prefix_tokens, the running sums at pre-token borders."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    more = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fit_chars", T.LongType())]
    more += [("prefix_chars", T.ArrayType(T.IntegerType())), ("prefix_tokens", T.ArrayType(T.IntegerType()))] * with_prefixes
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, t) for n, t in more]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _COUNTERS.get((path, pattern)) or _COUNTERS.setdefault((path, pattern), PrefixCounter(path, pattern))
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py() or ""
                pieces, counts = own.counts(t)
                sums = np.cumsum(np.array(counts, dtype=np.int64)) if counts else np.zeros(0, np.int64)
                n = int(sums[-1]) if counts else 0
                row = [len(t.encode()), n, n > budget]
                row.append(len(t) if n <= budget else sum(map(len, pieces[: int(np.searchsorted(sums, budget, side="right"))])))
                rows.append((*row, list(accumulate(map(len, pieces))), sums.tolist()) if with_prefixes else row)
            new = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate([pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.list_(pa.int32())] * 2 * with_prefixes])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
