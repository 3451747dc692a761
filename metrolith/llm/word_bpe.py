"""BPE encoding and decoding of words with word ends, by a contiguous rank array.

A text is cut at its special tokens and then at white space; a chunk between white space is normalised (NFC, lower case),
split by the file's own pattern, written in byte letters, and its last letter takes the word-end suffix. A word then holds
three arrays side by side: where its parts begin, the parts, and the rank of each part with the next. The smallest rank is
found by scanning, the boundary behind it deleted, and the ranks of the two neighbours refreshed, until no rank is left.
Scanning costs the square of a word's length, so a word of over LONGEST_SCANNED letters finds its smallest rank in a heap.
Chunks and words that a worker has coded stay in stores of bounded bytes; long ones are never stored.

Decoding is what a file without a decoder asks for: the tokens' own strings, joined by one space.

Defined results: a null text counts as empty (no ids, decodes to an empty string); special tokens inside texts become their
ids, as the file's library does by default; a null array of ids decodes to an empty string, an id outside the vocabulary to
nothing; repeated rows are coded row by row; an empty table gives an empty table; other columns are dropped unless in `keep`.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Letters of the longest word whose ranks are scanned.
LONGEST_SCANNED = 300
#: Bytes of each of a worker's two stores, what an entry costs besides its letters and ids, and the letters of the longest kept.
STORE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 96_000_000, 180, 100
#: Characters of text behind one batch of results.
BATCH_CHARS = 2_000_000
#: White space to str.split() that patterns take for symbols.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
NEVER = 1 << 62


def byte_letters() -> str:
    """The printable letter of each byte, 0 to 255, in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class Store(dict):
    """Codes by string, made by `make` where missing. Half of `limit` bytes fills one generation; when it is full it becomes
    the older one, from which entries still asked for come back, and the one before is forgotten."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.older = make, limit, 0, {}

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.make(text)
        if len(text) <= LONGEST_KEPT:
            if 2 * self.held > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[text] = out
            self.held += ENTRY_BYTES + 4 * len(text) + len(out)
        return out


class WordEncoder:
    """Words to ids and back by a vocabulary file of the tokenizers library with word ends."""

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: no vocabulary of lower-cased words with word ends")
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"]
        self.ranks: dict[int, int] = {}  # left id, right id -> rank, made id
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.ranks[self.vocab[a] << 24 | self.vocab[b]] = n << 24 | self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else lambda text: [text]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.familiar: set[str] = set()
        self.newest = Tokenizer.from_file(path)
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.of_word, self.of_chunk = Store(self.code_word, store_bytes), Store(self.code, store_bytes)

    def scan(self, parts: list[int]) -> list[int]:
        """Merges parts in place: the smallest rank first, of equal ranks the left one."""
        rank_of = self.ranks.get
        ranks = [rank_of(a << 24 | b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) != NEVER:
            i = ranks.index(least)
            parts[i : i + 2] = [least & 0xFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 24 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 24 | parts[i + 1], NEVER)
        return parts

    def pop(self, parts: list[int]) -> list[int]:
        """What scan() gives, with the ranks in a heap and the boundaries in a linked list."""
        rank_of, n = self.ranks.get, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 24 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if parts[i] < 0 or (j := after[i]) == n or rank_of(parts[i] << 24 | parts[j]) != rank:
                continue  # a neighbour has changed since
            parts[i], parts[j], after[i] = rank & 0xFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(parts[i] << 24 | parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of(parts[before[i]] << 24 | parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def split(self, chunk: str) -> Iterable[str]:
        """The words of a chunk, in byte letters."""
        if not self.familiar.issuperset(chunk):
            self.familiar.update(c for c in chunk if category(c) != "Cn")
        if not self.familiar.issuperset(chunk):  # letters newer than Python's tables
            shown = self.newest.pre_tokenizer.pre_tokenize_str(self.newest.normalizer.normalize_str(chunk))
            return [word for word, _ in shown]
        words = self.words(normalize("NFC", chunk).replace("Σ", "σ").lower())  # each letter on its own, so no final sigma
        return [w.encode().decode("latin-1").translate(self.letters) for w in words]

    def code_word(self, letters: str) -> bytes:
        parts = [self.vocab[c] for c in letters[:-1]]
        parts.append(self.vocab[letters[-1] + self.suffix])
        return array("i", self.scan(parts) if len(parts) <= LONGEST_SCANNED else self.pop(parts)).tobytes()

    def code(self, chunk: str) -> bytes:
        """The ids of a chunk, as 32-bit integers."""
        return b"".join(map(self.of_word.__getitem__, self.split(chunk)))

    def encode(self, text: str) -> np.ndarray:
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(np.array([self.special[part]], dtype=np.int32).tobytes())
            else:
                out += map(self.of_chunk.__getitem__, [part] if _ODD_SPACE.search(part) else part.split())
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.token.__getitem__, ids))
        except KeyError:
            return " ".join(self.token[i] for i in ids if i in self.token)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, WordEncoder(path))


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


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """`keep` and ids array<int>: each whole text by the vocabulary file at `path`. decoded: also decoded string, what decode()
    adds, without a second pass through Python."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    more = [T.StructField("decoded", T.StringType(), False)] if decoded else []
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(batch.num_columns - 1)):
                ids = [own.encode(t) for t in block]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                arrays = [batch.column(i).slice(at, len(block)) for i in range(batch.num_columns - 1)]
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                if decoded:
                    arrays.append(pa.array([own.decode(x.tolist()) for x in ids], pa.string()))
                at += len(block)
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded string: the tokens' strings, special ones included, joined by one space."""
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType(), False)])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for batch in batches:
            out = [own.decode(x.as_py() or []) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def id_digest(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Adds n_tokens and ids_sha256, the lowercase hex digest of the decimal ids joined by one space."""
    column = F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))
    return df.withColumns({"n_tokens": F.size(column).cast("long"), "ids_sha256": F.sha2(F.array_join(column.cast("array<string>"), " "), 256)})
