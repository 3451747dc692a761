"""Finding strings that repeat anywhere in a corpus: documents in blocks, fingerprints in buckets.

Texts are dealt into blocks by id once, and that exchange is used by every pass. A pass over the blocks offers each
bucket the distinct fingerprints of its block (a fingerprint that fills a third of the corpus is offered once per block);
a pass over the buckets answers every offer with what other blocks hold. Two such rounds, the first on sparse anchors
and the second on what surrounds the repeated ones, end in a pass that gives each document its row. No pass holds more
than one block or one bucket, and both shrink as their number grows with spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks for each shuffle partition (there are as many buckets as partitions); bytes of text that are hashed at a time. A
#: block writes one row for each bucket it has something for, so rows are of the order of the parts of Spark's own shuffle.
BLOCKS, SLICE_BYTES = 2, 1 << 17
#: Stands for a null id: it comes after all others.
NO_ID = np.iinfo(np.int64).max

_random = np.random.default_rng(20240229)
BYTE_CODES = _random.integers(1, 2**63, size=(2, 256), dtype=np.uint64)
BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)
INVERSES = np.array([pow(int(b), -1, 2**64) for b in BASES], dtype=np.uint64)

OFFER = "bucket int, block int, p0 binary, p1 binary, p2 binary, p3 binary"
REPLY = "block int, step int, bucket int, r0 binary"


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, kept up to the largest n so far."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.full(max(n, SLICE_BYTES) + 1, base, dtype=np.uint64)
        known[0] = 1
        _powers[int(base)] = known = np.multiply.accumulate(known)
    return known[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a sum over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Hashes of any stretch of a sequence of 64-bit codes, equal for equal stretches wherever they stand."""

    def __init__(self, codes: np.ndarray, lane: int = 0):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * powers(BASES[lane], n)[:n], out=self.sums[1:])
        self.back = powers(INVERSES[lane], n)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])

    def runs(self, length: int) -> np.ndarray:
        """Of every full stretch of `length`."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


class Slice:
    """Some whole documents: their bytes in a row, and where each one starts."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, starts: np.ndarray, first: int):
        self.ids, self.data, self.starts, self.first = ids, data, starts, first


def slices(table: pa.Table) -> Iterator[Slice]:
    """The documents of a block in ascending order of id (a null id last), a few at a time. Columns: id, text, block."""
    order = np.argsort(_ids(table), kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    ids, text = _ids(table), table.column(1).combine_chunks() if table.num_rows else pa.array([], pa.string())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    if not len(ids):
        return
    _, offsets, data = text.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield Slice(ids[at:to], flat[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def _ids(table: pa.Table) -> np.ndarray:
    return table.column(0).fill_null(NO_ID).to_numpy()


def deal(hashes: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) of hashes, by ranges of their values; the places keep their order."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[p[0]]), p) for p in np.split(order, cuts) if len(p)]


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_ascending(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, the equal bytes of all in a row."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked_ascending(data: bytes, dtype=np.uint64) -> np.ndarray:
    planes = np.frombuffer(unpacked(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def offers(rows: list[tuple[int, int, list[bytes]]]) -> pa.Table:
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
    columns += [pa.array([(r[2] + [None] * 4)[i] for r in rows], pa.binary()) for i in range(4)]
    return pa.Table.from_arrays(columns, names=["bucket", "block", "p0", "p1", "p2", "p3"])


def replies(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "step", "bucket", "r0"])


def reply_of(table: pa.Table, step: int) -> dict[int, bytes]:
    return {r["bucket"]: r["r0"] for r in table.to_pylist() if r["step"] == step}


def offer_hashes(hashes: np.ndarray, block: int, n_buckets: int) -> pa.Table:
    """hashes: sorted, each once."""
    return offers([(b, block, [packed_ascending(hashes[p])]) for b, p in deal(hashes, n_buckets)])


def answer_hashes(step: int) -> Callable:
    """For each offered hash a bit: whether another block offers it too."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        given = [unpacked_ascending(r["p0"]) for r in rows]
        every = np.sort(np.concatenate(given)) if given else np.zeros(0, dtype=np.uint64)
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        return replies([(r["block"], step, r["bucket"], np.packbits(found(g, twice)).tobytes()) for r, g in zip(rows, given, strict=True)])

    return answer


def found(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def told(hashes: np.ndarray, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """The bits of answer_hashes for the sorted hashes that offer_hashes took."""
    out = np.zeros(len(hashes), dtype=bool)
    for b, p in deal(hashes, n_buckets):
        out[p] = np.unpackbits(np.frombuffer(answers[b], dtype=np.uint8), count=len(p)).astype(bool)
    return out


def run(df: DataFrame, key: str, text: str, schema: T.StructType, first: Callable, answer_first: Callable, second: Callable, answer_second: Callable, last: Callable) -> DataFrame:
    """first(block, docs, n) and second(block, docs, replies, n) make offers to n buckets; last(block, docs, replies, n) makes
    the rows."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = BLOCKS * n
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(n_blocks)).cast("int"))
    held = docs.groupBy("block")
    one = held.applyInArrow(lambda k, t: first(k[0].as_py(), t, n), OFFER).groupBy("bucket").applyInArrow(answer_first, REPLY).repartition("block")  # both uses below share this exchange
    two = held.cogroup(one.groupBy("block")).applyInArrow(lambda k, t, r: second(k[0].as_py(), t, r, n), OFFER).groupBy("bucket").applyInArrow(answer_second, REPLY)
    return held.cogroup(one.unionAll(two).groupBy("block")).applyInArrow(lambda k, t, r: last(k[0].as_py(), t, r, n), schema)
