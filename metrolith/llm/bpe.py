"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task reads its share of the corpus in blocks of whole documents. The distinct pre-tokens of a block form one flat
symbol array with an inverted index from the rank of a token pair to the positions where that pair stands. Ranks are
replayed in order over all pre-tokens of the block at once, and only the neighbours that a merge touches get new index
entries. Words already replayed are kept in a bounded store per worker, so a frequent word is replayed once.

Defined results: null text counts as empty (no ids); empty text gives no ids and decodes to nothing; repeated rows and
ids are encoded row by row; an empty table gives an empty table; other columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text in one block, words kept by a worker between blocks, and the letters of the longest of them.
BLOCK_CHARS, KEPT_WORDS, LONGEST_KEPT = 2_000_000, 200_000, 100


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """The merge table of a rank file, and the replay of its merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair doesn't merge (a negative symbol never does)."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.made[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first: the definition, for single words."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.width), i) for i in range(len(parts) - 1))
            if rank == self.width:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1  # a gap of one symbol stands before each word
        owner = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(flat)) + owner + 1
        n = len(flat) + len(words) + 1
        symbol = np.full(n, -1, dtype=np.int64)
        symbol[place] = self.first[flat]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = n - 1
        before[0] = 0

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(rank: np.ndarray, at: np.ndarray) -> None:
            found = rank >= 0
            rank, at = rank[found], at[found]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, where in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heapq.heappush(queue, r)

        add(self.rank_of_pairs(symbol[:-1], symbol[1:]), np.arange(n - 1))
        odd: list[np.ndarray] = []
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            right = after[at]
            live = self.rank_of_pairs(symbol[at], symbol[right]) == rank  # an entry is stale once a neighbour has changed
            at, right = at[live], right[live]
            if len(at) > 1 and (right[:-1] == at[1:]).any():  # of overlapping pairs the left one merges
                keep, taken = np.ones(len(at), dtype=bool), -1
                for i, (a, b) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                    keep[i] = a != taken
                    taken = b if keep[i] else taken
                at, right = at[keep], right[keep]
            if not len(at):
                continue
            symbol[at], symbol[right] = rank, -2
            after[at] = after[right]
            before[after[at]] = at
            left_of, right_of = before[at], after[at]
            left_rank = self.rank_of_pairs(symbol[left_of], symbol[at])
            right_rank = self.rank_of_pairs(symbol[at], symbol[right_of])
            if (early := ((left_rank >= 0) & (left_rank < rank)) | ((right_rank >= 0) & (right_rank < rank))).any():
                odd.append(at[early])  # a rank before this one became possible: such a word is done by the definition
            add(np.concatenate([left_rank, right_rank]), np.concatenate([left_of, at]))
        left = symbol >= 0
        ids = symbol[left]
        ends = np.cumsum(left)[start + size - 1]
        out = np.split(ids, ends[:-1])
        if odd:
            for i in np.unique(np.searchsorted(start, np.concatenate(odd), side="right") - 1).tolist():
                out[i] = np.array(self.one_word(words[i]), dtype=np.int64)
        return out


class BlockEncoder:
    """Encodes blocks of texts, with a bounded store of words that earlier blocks have replayed."""

    def __init__(self, path: str, pattern: str, kept: int = KEPT_WORDS):
        self.table, self.split, self.kept, self.known = MergeReplay(read_ranks(path)), regex.compile(pattern).findall, kept, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.split(t) for t in texts]
        if len(self.known) > self.kept:
            self.known.clear()
        new = sorted({w for p in pieces for w in p if w not in self.known})
        for word, ids in zip(new, self.table.replay([w.encode() for w in new]), strict=True):
            self.known[word] = ids.astype(np.int32).tobytes()
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, p)), dtype=np.int32) for p in pieces]
        for word in new:
            if len(word) > LONGEST_KEPT:  # so the store is bounded in bytes too
                del self.known[word]
        return out


_ENCODERS: dict[tuple[str, str], BlockEncoder] = {}


def _blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t or "")
        chars += len(block[-1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """`keep` and ids array<int>: each whole text by the ranks in `path`, each match of `pattern` on its own. decoded: also
    bytes, what the ids stand for, as decode() adds it, without a second Python worker for each task."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    more = [T.StructField("bytes", T.BinaryType(), False)] if decoded else []
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ENCODERS.get((path, pattern)) or _ENCODERS.setdefault((path, pattern), BlockEncoder(path, pattern))
        for batch in batches:
            at = 0
            for block in _blocks(v.as_py() for v in batch.column(batch.num_columns - 1)):
                ids = own.encode(block)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays = [batch.column(i).slice(at, len(block)) for i in range(batch.num_columns - 1)]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                if decoded:
                    arrays.append(pa.array([decode_ids(x, path) for x in ids], pa.binary()))
                at += len(block)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(run, schema)


_VOCABULARIES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token bytes in a row, and each id's start and size there."""
    if path not in _VOCABULARIES:
        token = {rank: t for t, rank in read_ranks(path).items()}
        parts = [token.get(i, b"") for i in range(max(token) + 1)]
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        _VOCABULARIES[path] = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(size) - size, size
    return _VOCABULARIES[path]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    flat, start, size = _vocabulary(path)
    n = size[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start[ids] - (ends - n), n) + np.arange(total)].tobytes()


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds bytes binary: what the ids stand for. A null array decodes to nothing."""
    schema = T.StructType([*df.schema.fields, T.StructField("bytes", T.BinaryType(), False)])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            out = [decode_ids(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32), path) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def id_digest(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Adds n_tokens and ids_sha256, the lowercase hex digest of the decimal ids joined by commas."""
    column = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return df.withColumns({"n_tokens": F.size(column).cast("long"), "ids_sha256": F.sha2(F.array_join(column.cast("array<string>"), ","), 256)})


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
