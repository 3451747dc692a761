"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to DIMENSIONS features. Document frequencies are counted over the whole corpus; a randomised SVD of the
TF-IDF passages of all texts, and of the benchmark items, gives a latent space: every task multiplies its passages by a
random matrix and back, the sums (features x rank, of fixed size) are orthogonalised, and a second pass gives the singular
values, by which the space is whitened. Copies of a text weigh together as one text, so no text that is copied often takes
the space for itself. Then overlapping windows of every text, of about an item's length, are
compared with the items of that length by cosine, and candidates are confirmed on the words themselves: the longest common
subsequence must hold `verbatim` of the item, or `paraphrase` of it together with the words of its answer, its last
sentence.

Defined results: null and empty texts hold nothing; an empty benchmark marks nothing; items without words are ignored;
repeated rows are marked row by row; an empty table gives an empty table; other columns are dropped unless named in
`keep`. Benchmarks of more than `item_block` items are taken in blocks, each compared with all texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolith.llm import blocks as B
from metrolith.llm.scratch import cut
from metrolith.llm.substring_dedup import Words

DIMENSIONS, CHUNK = 1 << 15, 1 << 11
#: Texts with copies that are looked up by broadcast; tasks of a pass of the fit, at least: each sends sums of features x rank.
BROADCAST, LEAST_TASKS = 1_000_000, 16
#: Features that stand more often in a slice of text than all but so many others are summed one by one.
OFTEN = 40
#: Blocks of a window; windows start at every block. The shortest windows have SHORTEST words, longer ones twice as many each.
STEPS, SHORTEST = 4, 8
GAP = np.ones(256, dtype=bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Settings:
    """The latent space is fitted on all documents, or on about fit_docs of them where that is set; items_weight counts each
    item so often."""

    rank: int = 64
    fit_docs: int | None = None
    passage_words: int = 32
    items_weight: float = 16.0
    min_cosine: float = 0.5
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.7
    item_block: int = 1_000


def _lowered(column: pa.Array) -> pa.Table:
    text = pc.utf8_lower(pc.fill_null(column, ""))
    return pa.table({"id": pa.array(np.arange(len(column))), "text": text})


def _features(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int32)


def _slices(column: pa.Array) -> Iterator[tuple[B.Slice, Words]]:
    for part in B.slices(_lowered(column)):
        yield part, Words(part, GAP, lanes=1)


def document_frequencies(df: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Of each feature, the texts that hold it, over the whole table; and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for part, words in _slices(batch.column(0)):
                doc = np.repeat(np.arange(len(part.ids)), np.diff(words.starts))
                pairs = np.unique(doc * DIMENSIONS + _features(words.codes[0]))
                total += np.bincount(pairs % DIMENSIONS, minlength=DIMENSIONS)
                n += len(part.ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"])

    rows = df.select(F.col(f"`{text}`")).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    out[rows.column("feature").to_numpy()] = rows.column("n").to_numpy()
    return out[:DIMENSIONS], int(out[DIMENSIONS])


class Table:
    """A vector for each feature; sums them over blocks of words."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.zeros((len(vectors) + 1, vectors.shape[1]), dtype=np.float32)
        self.vectors[:-1] = vectors

    def sums(self, features: np.ndarray, block: int) -> np.ndarray:
        out = self.vectors[features[::block]]
        more = np.empty_like(out)
        for i in range(1, block):
            out += np.take(self.vectors, features[i::block], axis=0, out=more, mode="clip")
        return out

    def blocks(self, words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector of each block, document of each block, padded features): a document's last block may be short."""
        n = np.diff(words.starts)
        many = -(-n // block)
        first = np.cumsum(many) - many
        at = np.arange(len(words.begin)) + np.repeat(first * block - words.starts[:-1], n)
        padded = np.full(int(many.sum()) * block, DIMENSIONS, dtype=np.int32)
        padded[at] = _features(words.codes[0])
        return self.sums(padded, block), np.repeat(np.arange(len(n)), many), padded


def spread(y: np.ndarray, padded: np.ndarray, block: int, total: np.ndarray) -> None:
    """Adds to each feature's row of total the rows of y, one for each block of padded features, that it stands in."""
    order = np.argsort(padded.astype(np.uint16), kind="stable")  # by radix; the padding, DIMENSIONS, comes last
    order = order[: np.count_nonzero(padded < DIMENSIONS)]
    ranked, place = padded[order], order // block
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    size = np.diff(first, append=len(ranked))
    often = np.argsort(-size, kind="stable")
    first, size = first[often], size[often]
    sums = y[place[first]]
    more = np.empty_like(sums)
    done, left = 1, int(np.count_nonzero(size > 1))
    while left > OFTEN:  # the second occurrence of all features that have one, then the third ones
        sums[:left] += np.take(y, place[first[:left] + done], axis=0, out=more[:left], mode="clip")
        done += 1
        left = int(np.searchsorted(-size, -done, side="left"))
    for i in range(left):
        sums[i] += y[place[first[i] + done : first[i] + size[i]]].sum(axis=0)
    total[ranked[first]] += sums


def _gathered(passages: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """The sum over all tasks of a matrix to which add(total, words, weight) adds texts, flat (empty without texts): chunks of
    rows travel and are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            for part, words in _slices(batch.column(0)):
                total = np.zeros(shape, dtype=np.float32) if total is None else total
                add(total, words, weight[part.ids])
        if total is not None:
            for k, i in enumerate(range(0, len(total), CHUNK)):  # one by one, so that neither side holds the matrix twice
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[i : i + CHUNK].tobytes()], pa.binary())], names=["chunk", "data"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.float32).astype(np.float64) for x in table.column("data"))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    told = passages.mapInArrow(run, "chunk int, data binary").groupBy("chunk").applyInArrow(summed, "chunk int, data binary").toArrow().sort_by("chunk")
    return np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(x.as_buffer(), dtype=np.float32) for x in told.column("data")]])


def orthonormal(z: np.ndarray, rows: int = 1 << 12) -> np.ndarray:
    """An orthonormal basis of what the columns of z span: blocks of rows are decomposed one by one, then their triangles
    together, so that beside z and the basis only a block is held. z: as many rows as columns at least."""
    blocks = range(0, len(z), rows)
    basis, triangles = np.empty(z.shape), []
    for i in blocks:
        q, r = np.linalg.qr(z[i : i + rows].astype(np.float64))
        basis[i : i + rows, : q.shape[1]] = q
        triangles.append(r)
    ends = np.cumsum([len(r) for r in triangles])
    q, _ = np.linalg.qr(np.vstack(triangles))
    for i, r, end in zip(blocks, triangles, ends, strict=True):
        basis[i : i + rows] = basis[i : i + rows, : len(r)] @ q[end - len(r) : end]
    return basis


def fit(texts: DataFrame, idf: np.ndarray, settings: Settings) -> np.ndarray:
    """The feature vectors of the whitened latent space, by a randomised SVD of the passages of texts (text, weight)."""
    size, rank = settings.passage_words, settings.rank
    width = rank + 8
    start = np.random.default_rng(11).standard_normal((DIMENSIONS, width), dtype=np.float32)
    start *= idf[:, None]

    def forward(table: Table, words: Words, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, doc, padded = table.blocks(words, size)
        return y * weight[doc].astype(np.float32)[:, None], padded

    def back_and_forth(table: Table):
        def add(total: np.ndarray, words: Words, weight: np.ndarray) -> None:
            y, padded = forward(table, words, weight**2)
            spread(y, padded, size, total)

        return add

    def squared(table: Table):
        def add(total: np.ndarray, words: Words, weight: np.ndarray) -> None:
            y, _ = forward(table, words, weight)
            total += y.T @ y

        return add

    z = _gathered(texts, (DIMENSIONS, width), back_and_forth(Table(start)))
    if not len(z):
        return np.zeros((DIMENSIONS, rank))
    z = z.reshape(DIMENSIONS, width)
    z *= idf[:, None]
    basis = orthonormal(z)
    del z
    np.multiply(basis, idf[:, None], out=start, casting="same_kind")
    values, vectors = np.linalg.eigh(_gathered(texts, (width, width), squared(Table(start))).reshape(width, width).astype(np.float64))
    del start
    top = np.argsort(values)[::-1][:rank]
    top = top[values[top] > 1e-6 * max(values.max(), 1e-12)]
    out = basis @ (vectors[:, top] / np.sqrt(values[top]))
    out *= idf[:, None]
    return out


@dataclass
class Item:
    item_id: int
    codes: list[int]
    mask: dict[int, int]
    answer: set[int]


def common_subsequence(mask: dict[int, int], size: int, codes: list[int]) -> int:
    """Length of the longest common subsequence; mask: of each code, the places where the item has it, as bits."""
    full = (1 << size) - 1
    left = full
    for c in codes:
        if m := mask.get(c):
            u = left & m
            left = ((left + u) | (left - u)) & full
    return size - left.bit_count()


def read_items(rows: list[tuple[int, str]]) -> list[Item]:
    out = []
    texts = [t or "" for _, t in rows]
    answers = [re.split(r"[.!?]\s", t.rstrip())[-1] for t in texts]
    for (id_, _), codes, answer in zip(rows, _codes(texts), _codes(answers), strict=True):
        if codes and id_ is not None:
            mask: dict[int, int] = {}
            for i, c in enumerate(codes):
                mask[c] = mask.get(c, 0) | 1 << i
            out.append(Item(id_, codes, mask, set(answer)))
    return out


def _codes(texts: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for part, words in _slices(pa.array(texts, pa.string())) if texts else ():
        out += [words.codes[0][words.starts[i] : words.starts[i + 1]].tolist() for i in range(len(part.ids))]
    return out


class Matcher:
    def __init__(self, items: list[Item], vectors: np.ndarray, settings: Settings):
        self.items, self.settings, self.table = items, settings, Table(vectors)
        features = [_features(np.array(i.codes, dtype=np.uint64)) for i in items]
        latent = np.array([self.table.vectors[f].sum(axis=0) for f in features]).reshape(len(items), self.table.vectors.shape[1])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        self.sizes = np.array([len(i.codes) for i in items], dtype=np.int64)
        self.vocabulary = np.unique(np.array([c for i in items for c in i.mask], dtype=np.uint64))
        self.many = np.zeros((len(items), len(self.vocabulary)), dtype=np.uint16)
        for i, item in enumerate(items):
            self.many[i, np.searchsorted(self.vocabulary, np.array(list(item.mask), dtype=np.uint64))] = [m.bit_count() for m in item.mask.values()]
        level = np.array([max(0, round(math.log2(len(i.codes) / SHORTEST))) for i in items], dtype=np.int64)
        self.levels = [(int(k), np.flatnonzero(level == k), np.ascontiguousarray(latent[level == k].T)) for k in np.unique(level)]

    def candidates(self, words: Words) -> np.ndarray:
        """Rows (document, item, first word, last word + 1) of windows with a high cosine, with half an item's length around.

        Each document is followed by blanks as long as the longest window, so no window meets two documents."""
        out = [np.zeros((0, 4), dtype=np.int64)]
        if not self.levels:
            return out[0]
        least, top = SHORTEST // STEPS << self.levels[0][0], SHORTEST // STEPS << self.levels[-1][0]
        n = np.diff(words.starts)
        long = (-(-n // top) + STEPS - 1) * top * (n > 0)
        begin = np.cumsum(long) - long
        features = np.full(int(long.sum()), DIMENSIONS, dtype=np.int32)
        features[np.arange(len(words.begin)) + np.repeat(begin - words.starts[:-1], n)] = _features(words.codes[0])
        sums, size = self.table.sums(features, least), least
        for k, which, latent in self.levels:
            while size < SHORTEST // STEPS << k:
                sums, size = sums[::2] + sums[1::2], size * 2
            window = sums[: len(sums) - STEPS + 1].copy()
            for i in range(1, STEPS):
                window += sums[i : len(sums) - STEPS + 1 + i]
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            w, i = np.divmod(np.flatnonzero(window @ latent >= (self.settings.min_cosine * norm + 1e-9)[:, None]), latent.shape[1])
            d = np.searchsorted(begin, w * size, side="right") - 1
            first = w * size - begin[d]
            real = first < n[d]
            d, i, first = d[real], which[i[real]], first[real]
            half, start = self.sizes[i] // 2, words.starts[d]
            out.append(np.stack([d, i, start + np.maximum(0, first - half), start + np.minimum(n[d], first + STEPS * size + half)], axis=1))
        return np.concatenate(out)

    def possible(self, words: Words, rows: np.ndarray) -> np.ndarray:
        """The candidates that hold enough of the item's words, in any order."""
        place = np.searchsorted(self.vocabulary, words.codes[0])
        place[place == len(self.vocabulary)] = 0
        place[self.vocabulary[place] != words.codes[0]] = -1
        size = rows[:, 3] - rows[:, 2]
        row = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(row)) + np.repeat(rows[:, 2] - (np.cumsum(size) - size), size)
        word, item = place[at], rows[row, 1]
        known = (word >= 0) & (self.many[item, word] > 0)
        pair, count = np.unique(row[known] * len(self.vocabulary) + word[known], return_counts=True)
        row, word = np.divmod(pair, len(self.vocabulary))
        held = np.bincount(row, weights=np.minimum(count, self.many[rows[row, 1], word]), minlength=len(rows))
        return rows[held >= min(self.settings.paraphrase, self.settings.verbatim) * self.sizes[rows[:, 1]]]

    def matches(self, words: Words) -> dict[int, dict[int, float]]:
        """document -> item id -> share of the item that the document holds in order."""
        out: dict[int, dict[int, float]] = {}
        if not self.items:
            return out
        s, codes = self.settings, words.codes[0]
        for d, i, begin, end in self.possible(words, self.candidates(words)).tolist():
            item = self.items[i]
            if out.get(d, {}).get(item.item_id, 0) >= 1:
                continue
            near = codes[begin:end].tolist()
            share = common_subsequence(item.mask, len(item.codes), near) / len(item.codes)
            if share >= s.verbatim or share >= s.paraphrase and len(item.answer & set(near)) >= s.answer * len(item.answer):
                found = out.setdefault(d, {})
                found[item.item_id] = max(share, found.get(item.item_id, 0.0))
        return out


def latent_space(df: DataFrame, items: DataFrame, settings: Settings, text: str, item_text: str) -> np.ndarray:
    counts, n = document_frequencies(df, text)
    idf = np.log1p((1 + n) / (1 + counts))  # a word of all texts counts a little too, so no item of words has a zero vector
    hashed = df.select(F.col(f"`{text}`").alias("text")).where("text is not null").withColumn("hash", F.xxhash64("text"))
    if settings.fit_docs is not None:
        share = min(1.0, settings.fit_docs / max(1, n))
        hashed = hashed.where(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    copies = cut(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    few = copies.count() <= BROADCAST
    docs = hashed.join(F.broadcast(copies) if few else copies, "hash", "left").select("text", F.pow(F.coalesce("n", F.lit(1)), F.lit(-0.5)).alias("weight"))
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, LEAST_TASKS)
    return fit(docs.coalesce(tasks).unionAll(items.select(F.col(f"`{item_text}`").alias("text"), F.lit(settings.items_weight).alias("weight")).coalesce(1)), idf, settings)


def mark(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """`keep`, contaminated, n_items, item_ids (ascending) and best_share (null without an item) for every row."""
    items = benchmark.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("item_text"))
    n_blocks = -(-max(1, items.count()) // settings.item_block)
    vectors = latent_space(df, items, settings, text, "item_text")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    found = T.StructField("__found", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("share", T.DoubleType())])))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64())]))
    out = source
    for block in range(n_blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).orderBy("item_id", "item_text").collect()]
        shared = df.sparkSession.sparkContext.broadcast((rows, vectors.astype(np.float32)))  # at most item_block items and features x rank
        last = block == n_blocks - 1
        known = [f for f in out.schema.fields if f.name == "__found"]
        before = [f for f in out.schema.fields if f.name not in ("__text", "__found")]
        schema = T.StructType([*before, *([] if last else [T.StructField("__text", T.StringType())]), found])

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, names=tuple(schema.fieldNames()), n_keep=len(before), known=bool(known)) -> Iterator[pa.RecordBatch]:
            item_rows, space = shared.value
            matcher = Matcher(read_items(item_rows), space, settings)
            for batch in batches:
                column = batch.column(n_keep)
                hits: list[list[dict]] = batch.column(n_keep + 1).to_pylist() if known else [[] for _ in range(len(column))]
                for part, words in _slices(column):
                    for d, found in matcher.matches(words).items():
                        hits[int(part.ids[d])] += [{"item_id": i, "share": s} for i, s in found.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *([] if last else [column]), pa.array(hits, kind)], names=list(names))

        out = out.mapInArrow(run, schema)
    ids = F.array_sort(F.array_distinct(F.transform("__found", lambda f: f["item_id"])))
    return out.select(*[F.col(f"`{c}`") for c in keep], (F.size("__found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_max(F.transform("__found", lambda f: f["share"])).alias("best_share"))
