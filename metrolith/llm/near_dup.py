"""MinHash near-dedup with odd sketches.

Every text becomes a set of word shingles, a MinHash signature cut into bands, and two odd sketches: the samples of the
signature folded into a parity bitmap, whose differing bits estimate the similarity, and the whole set folded likewise,
whose differing bits never exceed the shingles in which two sets differ. Equal sets are one class from then on. Classes
that share a band are candidates: first each with the smallest class of its band (a star, so a band that a third of the
corpus shares gives one candidate per class). Candidates whose sketches differ too much go; the rest is confirmed on the
full shingle sets of both texts.

Where classes of one band still lie in different components, each is compared with one class of the band's largest
component, the hub, and from then on stands for the shingles in which it differs from it. Two texts that link differ in
few shingles, so what they have in common against the hub must be large, and one of the rarest of these differences is
common to both: a prefix filter, which is exact. In a group of thousands of near copies the rarest differences are in few
texts, so a text of many edits meets a few others and never the whole group.

Bands and sketch limit follow from the similarity: a linked pair shares no band, or fails its sketch, with a chance of
less than 1e-7 each.

Defined results: texts without words have an empty set and are linked with nothing; a text with fewer words than a
shingle is one shingle; rows with the same id are one document; a row with a null id is linked with nothing, has a null
component and is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm import blocks as B
from metrolith.llm.scratch import cut, let
from metrolith.llm.substring_dedup import Words

ROWS, MISS, SKETCH_BITS = 6, 1e-7, 1024
#: Ids up to this number (8 MB) are looked up by broadcast, so that texts which aren't wanted aren't shuffled; beyond it, by
#: shuffle.
BROADCAST_IDS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SIGNATURE = "id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, odd array<long>"


def bands_for(percent: int) -> int:
    s = percent / 100
    return math.ceil(math.log(MISS) / math.log(1 - s**ROWS))


def most_differing_bits(percent: int, samples: int) -> int:
    """Each differing sample flips two bits at most; fewer than m samples agree with a chance of less than MISS."""
    s, total, m = percent / 100, 0.0, 0
    while (total := total + math.comb(samples, m) * s**m * (1 - s) ** (samples - m)) < MISS:
        m += 1
    return 2 * (samples - m)


def _shingles(part: B.Slice, shingle: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Documents, and the distinct shingle hashes of each: (n, document, hash), in the order of both."""
    part = B.Slice(part.ids, FOLD[part.data], part.starts, part.first)
    words = Words(part)
    n = np.diff(words.starts)
    many = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))  # shingles of each document
    doc = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(doc)) + np.repeat(words.starts[:-1] - (np.cumsum(many) - many), many)
    hashes = words.sums(0).of(at, at + np.minimum(n, shingle)[doc])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return len(n), doc[new], hashes[new]


def _parity(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The odd sketch of each document's whole set: which bits an odd number of its shingles falls on."""
    bit = (B.mix(hashes) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(doc * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def _lists(values: np.ndarray, full: np.ndarray, n: int) -> pa.Array:
    """n lists, those at `full` with a row of values each, the others empty."""
    offsets = np.zeros(n + 1, dtype=np.int32)
    offsets[full + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(values.ravel()))


def signatures(df: DataFrame, percent: int, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    bands = bands_for(percent)
    samples = bands * ROWS
    draw = np.random.default_rng(77)
    factor, shift, salt = draw.integers(0, 2**63, size=(3, samples), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signed(part: B.Slice) -> tuple:
        n, doc, hashes = _shingles(part, shingle)
        size = np.bincount(doc, minlength=n)
        full = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[full]
        digest = np.zeros((n, 2), dtype=np.uint64)
        least = np.zeros((samples, len(full)), dtype=np.uint64)
        if len(full):
            for lane in (0, 1):
                digest[full, lane] = np.add.reduceat(B.mix(hashes * B.BASES[lane]), first)
            for i in range(samples):
                least[i] = np.minimum.reduceat(hashes * factor[i] + shift[i], first)
        key_of = np.zeros((bands, len(full)), dtype=np.uint64)
        for b in range(bands):
            h = np.full(len(full), salt[b])
            for row in least[b * ROWS : (b + 1) * ROWS]:
                h = B.mix(h ^ row)
            key_of[b] = h
        bit = (B.mix(least ^ salt[:, None]) % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.zeros((len(full), SKETCH_BITS), dtype=np.int64)
        np.add.at(odd, (np.repeat(np.arange(len(full))[None], samples, axis=0), bit), 1)
        sketch = np.packbits((odd & 1).astype(np.uint8), axis=1).view(np.int64) if len(full) else np.zeros((0, SKETCH_BITS // 64), np.int64)
        return size, digest, full, key_of.T.copy().view(np.int64), sketch, _parity(doc, hashes, n)[full]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(pa.Table.from_batches([batch])):
                size, digest, full, *arrays = signed(part)
                ids = pa.array([None if i == B.NO_ID else i for i in part.ids.tolist()], pa.int64())
                digests = pa.array([d.tobytes() for d in digest], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), digests, *[_lists(a, full, len(size)) for a in arrays]], names=["id", "n_shingles", "digest", "bands", "sketch", "odd"])

    source = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return source.mapInArrow(run, SIGNATURE)


def shingle_set(text: Column, shingle: int) -> Column:
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        last = F.size(w) - shingle
        many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(shingle)]))
        return F.when(last >= 0, F.array_distinct(many)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def shingle_hashes(docs: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (the set, each shingle as 64 bits) and odd for each row of docs (id, text) with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(pa.Table.from_batches([batch])):
                n, doc, hashes = _shingles(part, shingle)
                starts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(starts), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(part.ids), sets, _lists(_parity(doc, hashes, n), np.arange(n), n)], names=["node", "hashes", "odd"])

    return docs.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "node long, hashes array<long>, odd array<long>").where(F.size("hashes") > 0)


def _linked(percent: int, n: Column, differing: Column) -> Column:
    """Whether sets of n shingles in all reach the similarity if `differing` shingles are in one of them only."""
    return (100 + percent) * differing <= (100 - percent) * n


def _may_link(percent: int, limit: int) -> Column:
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    exact = _linked(percent, F.col("n_a") + F.col("n_b"), _differing(F.col("odd_a"), F.col("odd_b")))
    return sizes & exact & (_differing(F.col("sketch_a"), F.col("sketch_b")) <= limit)


def _sketched(pairs: DataFrame, reps: DataFrame, percent: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches let them link."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("odd").alias(f"odd_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent, limit)).select("a", "b").distinct()


def of_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs with an id in wanted (id)."""
    wanted = cut(wanted)
    return docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; docs: id, text."""
    pairs = cut(pairs)
    if pairs.count() <= BROADCAST_IDS // 2:  # else the joins below share one exchange of docs, and a third would be one more
        docs = of_ids(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    one = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    sets = both.select("a", "b", shingle_set(F.col("text_a"), shingle).alias("x"), shingle_set(F.col("text_b"), shingle).alias("y"))
    shared = sets.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return shared.where((F.col("i") > 0) & (100 * F.col("i") >= percent * (F.col("n") - F.col("i")))).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (a, b): labels flow along edges and jump to
    the label of their label, so long chains halve; each round is checkpointed."""
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(up, "component").select("node", F.least("component", "up").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _against_hubs(banded: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """For the classes of bands that several components share: hub, node, component, n, odd, delta (the shingles that
    either the class or the hub has), d (how many), key (of the text), linked (with the hub)."""
    told = banded.join(labels, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    sizes = told.groupBy("band", "component").count()
    main = sizes.groupBy("band").agg(F.max(F.struct("count", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("band", F.col("m.component").alias("hub"))
    held = cut(told.join(main, "band").select("hub", "node", "component").distinct())
    hubs = held.select("hub").distinct()
    sets = cut(shingle_hashes(of_ids(docs, held.select(F.col("node").alias("id")).unionAll(hubs.select(F.col("hub").alias("id"))).distinct()), shingle))
    base = sets.withColumnRenamed("node", "hub").join(hubs, "hub", "left_semi").groupBy("hub").agg(F.min("hashes").alias("base"))
    delta = F.concat(F.array_except("hashes", "base"), F.array_except("base", "hashes"))
    near = held.join(sets, "node").join(base, "hub").select("hub", "node", "component", F.size("hashes").alias("n"), F.size("base").alias("n_hub"), "odd", delta.alias("delta"), F.xxhash64("hashes").alias("key"))
    return near.withColumn("d", F.size("delta")).withColumn("linked", _linked(percent, F.col("n") + F.col("n_hub"), F.col("d"))).drop("n_hub").dropDuplicates(["hub", "node", "key"])


def _across(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that may link; near: of _against_hubs.

    Sets of n and m shingles link if they differ in at most r (n + m), r = (100 - percent) / (100 + percent); that is n (100 -
    percent) / percent at most, as m is at most 100 n / percent. Against their hub they then have at least (d_a + d_b - r (n +
    m)) / 2 differences in common. That is below 1 only if both link with the hub, which `linked` tells. So one of the first
    r (n + m) / 2 + 1 of the text with fewer differences is among the first r (n + m) + 1 of the other, in any order that
    all share, here the rarest first."""
    same = ["hub", "node", "key"]
    parts = near.select(*same, F.explode("delta").alias("e"))
    often = parts.groupBy("hub", "e").count().where("count > 1")
    ranked = parts.join(often, ["hub", "e"]).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("count", "e"))).alias("shared"))
    whole = near.drop("delta").withColumn("component", F.when(F.col("linked"), F.col("hub")).otherwise(F.col("component")))
    lone = F.col("d") - F.size("shared")  # differences that no other text has come first
    most = F.floor(F.col("n") * (100 - percent) / percent).cast("int")
    told = whole.join(ranked, same).withColumns({"lone": lone, "most": most}).where("lone <= most")
    told = told.select("hub", "node", "component", "n", "d", "odd", "lone", "most", F.posexplode(F.slice("shared", F.lit(1), F.col("most") + 1 - F.col("lone"))).alias("place", "x"))
    told = cut(told.withColumn("place", F.col("place") + F.col("lone")).withColumn("e", F.col("x.e")).drop("x", "lone"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "d", "odd", "place")]
    few = told.where(F.col("place") <= F.floor(F.col("most") / 2)).select("hub", "e", *side("a"))
    total = F.col("n_a") + F.col("n_b")
    first = (F.col("d_a") < F.col("d_b")) | (F.col("d_a") == F.col("d_b")) & (F.col("node_a") < F.col("node_b"))
    in_common = F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b"))  # at most, if this is the first one
    fits = first & (F.col("component_a") != F.col("component_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    fits &= _linked(percent, total, F.col("d_a") + F.col("d_b") - 2 * in_common)
    met = few.join(told.select("hub", "e", *side("b")), ["hub", "e"]).where(fits & _linked(percent, total, _differing(F.col("odd_a"), F.col("odd_b"))))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def find(df: DataFrame, percent: int = 80, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: texts are linked where the Jaccard similarity of their
    shingle sets is at least percent / 100, and the smallest id of each component is kept."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = cut(signatures(df, percent, shingle, key, text))
    limit = most_differing_bits(percent, bands_for(percent) * ROWS)
    linked = signed.where("n_shingles > 0 and id is not null")
    classes = linked.groupBy("digest").agg(F.min("id").alias("node"))
    several = linked.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").select("id")
    of_id = cut(linked.select("id", "digest").join(several, "id", "left_semi").join(classes, "digest").select("id", "node").distinct())
    same_id = of_id.join(of_id.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    reps = cut(linked.join(classes, "digest").where("id = node").dropDuplicates(["node", "digest"]).select("node", "n_shingles", "bands", "sketch", "odd"))
    banded = reps.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    banded = cut(banded.join(shared, "band").select("band", "node", "pivot"))  # what meets nothing in any band ends here
    stars = banded.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    edges = cut(confirm(_sketched(stars, reps, percent, limit), docs, percent, shingle).unionAll(same_id))
    labels = components(edges)
    near = cut(_against_hubs(banded, labels, docs, percent, shingle))
    direct = near.where("linked and component <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rest = cut(direct.unionAll(_across(near, percent)).distinct())
    if not rest.isEmpty():
        labels = components(edges.unionAll(confirm(rest, docs, percent, shingle)))
    named = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    own = signed.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return own.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
