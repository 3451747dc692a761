"""Cross-tokenizer alignment by an event sweep.

Both tokenizers cut the same bytes: one space and the text. Each end of a token is an event with its offset, its side and the
token's id. The events of both sides are brought together by document, sorted by offset, and streamed through a machine
whose state is the open group: where both sides end at one offset the group closes, and its links (each A token with each
B token) are emitted. Events travel in blocks of BLOCK_BYTES of text, a side's lengths and ids in one row, so the sort has a
row per block and the machine holds two blocks at most.

Counts of links over the corpus: a pair's documents are counted after adding up within tasks. Pairs that many documents hold
are met by broadcast and the rest by a shuffle. The border is the number of all (document, pair) rows over HOT_PAIRS: so no
more than HOT_PAIRS pairs lie above it, and no pair that is shuffled has more than that share of the rows.

Defined results: texts null, empty, or not given back byte by byte by both vocabularies have no tokens and no groups; repeated
rows and ids are documents of their own; an empty table gives an empty table; other columns are dropped unless in `keep`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from metrolith.llm.scratch import table
from metrolith.llm.word_bpe import byte_letters

#: Bytes of text behind the events of one row, characters of text behind one batch of rows.
BLOCK_BYTES, BATCH_CHARS = 16_384, 500_000
#: Bytes of results, links and rows read that the machine's side holds at once.
BATCH_BYTES, ROWS_READ = 4_000_000, 1_000
#: Most pairs that are broadcast.
HOT_PAIRS = 200_000
#: Links of a group from which its ids are counted before they are paired.
LARGE_GROUP = 1 << 16

LINK = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.IntegerType(), False), T.StructField("times", T.LongType(), False)])


#: The letter that stands for a space in pieces.
SPACE = "\u2581"


class ByteSide:
    """Byte-level BPE of a .json file; special tokens in a text are plain text. As every byte is a token, its tokens always give
    the text back.

    The ranks are the ids, which grow with the merges. A vocabulary each of whose tokens is what its own bytes merge to gives
    the same ids by ranks as by its list of merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letter = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.raw = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        if not all(bytes([b]) in ranks for b in range(256)):  # else a text may not be given back
            raise ValueError(f"{path}: a byte has no token")
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype=np.int32)


class PieceSide:
    """Pieces of a .model file, which puts the leading space itself; a text that isn't given back as it was has the one id -1.

    Where ranks() can state the model, a text is coded from its bytes by ranks, a space and what follows it at a time. The
    library codes the rest, whole and compared with what its pieces give back: texts with a run of spaces, whose pieces share
    one score, texts with the letter that stands for a space, and all texts of other models."""

    def __init__(self, path: str, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        with open(path, "rb") as file:
            ranks = self.ranks(ModelProto.FromString(file.read()))
        self.encode = None
        if ranks:
            self.encode = tiktoken.Encoding("own", pat_str=" [^ ]*", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.made = [(self.own[t],) if t in self.own else tuple(self.of_byte[b] for b in t) for t in ranks]
            self.piece = np.array([ids[0] if len(ids) == 1 else -1 for ids in self.made], dtype=np.int32)

    def ranks(self, spec: ModelProto) -> dict[bytes, int] | None:
        """The bytes of all tokens in the order of their merges: bytes, letters with what they begin with, pieces by score. So
        the letters are whole before pieces are merged; what is no piece becomes its bytes' ids afterwards. None if the model
        changes texts, or if ranks don't give the ids that scores give."""
        how, normal, kind = spec.trainer_spec, spec.normalizer_spec, spec.SentencePiece
        if how.model_type != how.BPE or how.treat_whitespace_as_suffix or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            return None
        if not normal.add_dummy_prefix or not normal.escape_whitespaces or {p.type for p in spec.pieces} - {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}:
            return None
        self.of_byte = {self.raw[i][0]: i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        scored = [(-p.score, i, p.piece) for i, p in enumerate(spec.pieces) if p.type == kind.NORMAL and (p.piece == SPACE or p.piece.strip(SPACE))]
        if len(self.of_byte) < 256 or len({s for s, _, _ in scored}) < len(scored) or any(SPACE in p[1:] for _, _, p in scored):
            return None
        if any(self.model.encode(p[1:]) != [i] for _, i, p in scored if p[0] == SPACE and p != SPACE):  # not what its own letters merge to
            return None
        self.own = {self.raw[i]: i for _, i, _ in scored}
        letters = [c.encode() for c in {c for _, _, p in scored for c in p.replace(SPACE, " ")}]
        begun = sorted({c[:n] for c in letters for n in range(2, len(c) + 1)}, key=lambda t: (len(t), t))
        tokens = [*(bytes([b]) for b in range(256)), *begun, *(self.raw[i] for _, i, _ in sorted(scored))]
        return {t: n for n, t in enumerate(dict.fromkeys(tokens))}

    def ids(self, text: str) -> np.ndarray:
        if self.encode is None or "  " in text or SPACE in text:
            ids = self.model.encode(text[1:])
            exact = b"".join(map(self.raw.__getitem__, ids)) == text.encode()
            return np.array(ids if exact else [-1], dtype=np.int32)
        found = self.encode(text)
        ids = self.piece[np.array(found, dtype=np.int32)]
        return ids if ids.min() >= 0 else np.array([i for n in found for i in self.made[n]], dtype=np.int32)


_SIDES: dict[tuple[str, str], ByteSide | PieceSide] = {}


def side(path: str, pattern: str) -> ByteSide | PieceSide:
    """The tokenizer of a file; it stays in the worker."""
    if (path, pattern) not in _SIDES:
        own = _SIDES[path, pattern] = (PieceSide if path.endswith(".model") else ByteSide)(path, pattern)
        own.size = np.array([len(t) for t in own.raw], dtype=np.int64)
    return _SIDES[path, pattern]


def _types(path: str, pattern: str) -> tuple[np.dtype, np.dtype]:
    """The narrowest types for a side's lengths and ids."""
    own = side(path, pattern)
    return np.min_scalar_type(int(own.size.max())), np.min_scalar_type(len(own.raw))


def events(df: DataFrame, a: str, b: str, pattern: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """row, block, side, steps, ids: the ends of the tokens of both sides, as lengths from the one before, by blocks of a
    document. Side 0 of block -1 is the document itself and holds `keep`; a document without tokens has only this."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("__row"), F.col(f"`{text}`").alias("__text"))
    kept = [T.StructField(f.name, f.dataType, True) for f in source.schema.fields[:-2]]
    fixed = [("__row", T.LongType()), ("__block", T.IntegerType()), ("__side", T.IntegerType()), ("__steps", T.BinaryType()), ("__ids", T.BinaryType())]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in fixed]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(side(p, pattern), *_types(p, pattern)) for p in (a, b)]
        for batch in batches:
            rows, chars, last = [], 0, batch.num_rows - 1
            for i, (row, given) in enumerate(zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1), strict=True)):
                rows.append((i, row, -1, 0, None, None))
                t = given.as_py()
                if t:
                    found = [own.ids(" " + t) for own, _, _ in both]
                    if all(ids.min() >= 0 for ids in found):  # both give the text back: -1 stands for what a side doesn't
                        for k, (ids, (own, step_type, id_type)) in enumerate(zip(found, both, strict=True)):
                            steps, ids = own.size[ids].astype(step_type), ids.astype(id_type)
                            of = (np.cumsum(steps, dtype=np.int64) - 1) // BLOCK_BYTES
                            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(ids)] if of[-1] else [0, len(ids)]
                            rows += [(None, row, int(of[s]), k + 1, steps[s:e].tobytes(), ids[s:e].tobytes()) for s, e in zip(edges, edges[1:], strict=False)]
                    chars += len(t)
                if chars >= BATCH_CHARS or i == last:
                    columns = list(zip(*rows, strict=True))
                    place = pa.array(columns[0], pa.int32())
                    arrays = [batch.column(c).take(place) for c in range(len(kept))]
                    arrays += [pa.array(v, t) for v, t in zip(columns[1:], (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
                    rows, chars = [], 0

    return source.mapInArrow(run, schema)


class Machine:
    """Takes the events of one document in order of offsets; holds the group that is open."""

    def __init__(self, width_a: int, width_b: int):
        """The widths of the vocabularies."""
        self.base = 2 * width_a, width_b
        self.label = np.array([f"{i}{end}" for end in ",|" for i in range(width_a)] + [f"{i}{end}" for end in ",;" for i in range(width_b)], dtype="S")
        self.begin()

    def begin(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.ends, self.ids = [none, none], [none, none]
        self.reached = [0, 0]
        self.n_tokens, self.n_groups, self.n_links = [0, 0], 0, 0
        self.texts: list[bytes] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def take(self, which: int, steps: np.ndarray, ids: np.ndarray) -> None:
        """The next events of one side."""
        ends = np.cumsum(steps, dtype=np.int64) + self.reached[which]
        self.reached[which] = int(ends[-1])
        self.n_tokens[which] += len(ids)
        ids = ids.astype(np.int64)
        waits = len(self.ends[which]) > 0
        self.ends[which] = np.concatenate([self.ends[which], ends]) if waits else ends
        self.ids[which] = np.concatenate([self.ids[which], ids]) if waits else ids

    def close(self) -> None:
        """Closes the groups whose end both sides have reached."""
        (end_a, end_b), (id_a, id_b) = self.ends, self.ids
        if not len(end_a) or not len(end_b):
            return
        at = np.searchsorted(end_b, end_a)
        at[at == len(end_b)] = 0
        last_a = np.flatnonzero(end_b[at] == end_a)  # of each group, its last A token and its last B token
        if not len(last_a):
            return
        last_b = at[last_a]
        n_a, n_b = last_a + 1, last_b + 1
        n_a[1:] -= n_a[:-1].copy()
        n_b[1:] -= n_b[:-1].copy()
        closed_a, closed_b = int(last_a[-1]) + 1, int(last_b[-1]) + 1
        self.emit(id_a[:closed_a], id_b[:closed_b], n_a, n_b)
        self.ends = [end_a[closed_a:], end_b[closed_b:]]
        self.ids = [id_a[closed_a:], id_b[closed_b:]]

    def emit(self, id_a: np.ndarray, id_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Whole groups: their text and their links."""
        until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
        from_b = np.repeat(until_b - n_b, n_a)  # of each A token, the first B token of its group
        base, width_b = self.base
        show_a, show_b = id_a.copy(), id_b + base
        show_a[until_a - 1] += base // 2
        show_b[until_b - 1] += width_b
        shown = np.empty(len(id_a) + len(id_b), dtype=np.int64)
        shown[np.arange(len(id_a)) + from_b] = show_a
        shown[np.arange(len(id_b)) + np.repeat(until_a, n_b)] = show_b
        self.texts.append(self.label[shown].tobytes().translate(None, b"\0"))  # labels are filled up with zeros
        links = n_a * n_b
        self.n_groups += len(links)
        self.n_links += int(links.sum())
        for g in np.flatnonzero(links > LARGE_GROUP).tolist():
            a, times_a = np.unique(id_a[until_a[g] - n_a[g] : until_a[g]], return_counts=True)
            b, times_b = np.unique(id_b[until_b[g] - n_b[g] : until_b[g]], return_counts=True)
            self.keys.append((a[:, None] * width_b + b).ravel())
            self.times.append((times_a[:, None] * times_b).ravel())
        links = np.repeat(np.where(links > LARGE_GROUP, 0, n_b), n_a)  # of each A token
        until = np.cumsum(links)
        with_b = np.repeat(from_b - (until - links), links) + np.arange(int(until[-1]))
        keys, times = np.unique(np.repeat(id_a * width_b, links) + id_b[with_b], return_counts=True)
        self.keys.append(keys)
        self.times.append(times)

    def finish(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """The text of all groups, and the links: A ids, B ids, how often."""
        none = np.zeros(0, dtype=np.int64)
        keys, times = np.concatenate([none, *self.keys]), np.concatenate([none, *self.times])
        if len(self.keys) > 1:
            keys, of = np.unique(keys, return_inverse=True)
            times = np.bincount(of, weights=times, minlength=len(keys)).astype(np.int64) if self.n_links < 1 << 52 else _added(times, of, len(keys))
        return b"".join(self.texts)[:-1].decode(), keys // self.base[1], keys % self.base[1], times


def _added(times: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, of, times)
    return out


def align(df: DataFrame, a: str, b: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, row (a number of the document's own), n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: the ids of both
    sides, group by group), links array<struct<a, b, times>>: the linked ids and how often. a, b: vocabulary files, .json of
    byte-level BPE or .model of pieces; pattern: splits a text for byte-level BPE."""
    dealt = events(df, a, b, pattern, text, keep).repartition("__row").sortWithinPartitions("__row", "__block", "__side")
    kept = dealt.schema.fields[: len(keep)]
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType([*kept, T.StructField("row", T.LongType()), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(LINK, False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [_types(a, pattern), _types(b, pattern)]
        machine = Machine(len(side(a, pattern).raw), len(side(b, pattern).raw))
        open_row: tuple | None = None  # the document's header: its columns and its number
        block, done, size = -1, [], 0

        def whole() -> None:
            nonlocal size
            machine.close()
            shown, *links = machine.finish()
            done.append((*open_row, *machine.n_tokens, machine.n_groups, machine.n_links, shown, links))
            size += len(shown) + 24 * len(links[0])
            machine.begin()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.concat_arrays(c) for c in columns[: len(kept)]]
            arrays += [pa.array(c, pa.int64()) for c in columns[len(kept) : -2]] + [pa.array(columns[-2], pa.string())]
            offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in columns[-1]])]).astype(np.int32)
            flat = [np.concatenate([x[i] for x in columns[-1]]) for i in range(3)]
            structs = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2])], names=LINK.fieldNames())
            return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), structs)], names=schema.fieldNames())

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from (batch.slice(i, ROWS_READ) for i in range(0, batch.num_rows, ROWS_READ))

        for batch in parts():
            for i, (row, at, which, steps, ids) in enumerate(zip(*[batch.column(len(kept) + c).to_pylist() for c in range(5)], strict=True)):
                if not which:
                    if open_row is not None:
                        whole()
                    open_row, block = (*[batch.column(c).slice(i, 1) for c in range(len(kept))], row), 0
                    continue
                if at != block:
                    machine.close()
                    block = at
                step_type, id_type = types[which - 1]
                machine.take(which - 1, np.frombuffer(steps, step_type), np.frombuffer(ids, id_type))
            if size > BATCH_BYTES or len(done) >= 5_000:
                yield batch_of(done)
                done, size = [], 0
        if open_row is not None:
            whole()
            yield batch_of(done)

    return dealt.mapInArrow(run, schema)


def count_links(aligned: DataFrame, vocabulary: int) -> DataFrame:
    """Drops links and adds n_best (links whose pair is held by as many documents as any pair of their A id) and count_sum
    (the documents of a link's pair, added up over links). aligned: a written table, as it is read several times; vocabulary:
    the ids that A has at most, which bounds the table of highest counts."""
    flat = aligned.select("row", F.inline("links"))
    counts = table(flat.groupBy("a", "b").agg(F.count("*").alias("documents")))
    best = counts.groupBy("a").agg(F.max("documents").alias("most"))
    if vocabulary <= 1_000_000:
        best = F.broadcast(best)
    scored = counts.join(best, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))
    border = (counts.agg(F.sum("documents")).first()[0] or 0) // HOT_PAIRS + 1
    hot, cold = F.broadcast(scored.where(F.col("documents") >= border)), scored.where(F.col("documents") < border)

    def sums(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))

    parts = sums(flat.join(hot, ["a", "b"])).unionAll(sums(flat.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"])))
    added = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("links").join(added, "row", "left").select(*[F.col(f"`{c}`") for c in aligned.columns if c != "links"], zero("n_best"), zero("count_sum"))
