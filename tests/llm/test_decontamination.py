import math
import random
import re
from collections import Counter

import numpy as np
from metrolith.llm import decontamination as D
from pyspark.sql import functions as F

WORDS = [f"{a}{b}{c}" for a in ("ka", "le", "mi", "ro", "tu", "shan", "ve") for b in ("", "n", "st", "ri") for c in ("ol", "em", "a", "ing", "ure", "ed", "os")]


def text(draw, n):
    return " ".join(draw.choice(WORDS) if draw.random() < 0.8 else draw.choice(("the", "of", "and", "to")) for _ in range(n))


def plain_share(item, doc):
    """Longest common subsequence of the item and the best stretch of twice its length, as a share of the item."""
    a, b, best = item.lower().split(), doc.lower().split(), 0
    for start in range(0, max(1, len(b) - len(a)), max(1, len(a) // 2)):
        part = b[start : start + 2 * len(a)]
        row = [0] * (len(part) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(part):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        best = max(best, row[-1])
    return best / len(a)


def edited(draw, item, share):
    return " ".join(draw.choice(WORDS) if draw.random() < share else w for w in item.split())


def planted():
    draw = random.Random(4)
    items = [(i, text(draw, draw.choice([14, 25, 40, 70])) + ". " + text(draw, 4)) for i in range(30)]
    docs, holds = [], {}
    for i in range(240):
        words = text(draw, draw.choice([5, 40, 200, 600])).split()
        if i % 4 == 0:
            id_, item = draw.choice(items)
            at = draw.randrange(len(words))
            words[at:at] = (item if i % 8 else edited(draw, item, 0.08)).upper().split()
            holds[i] = id_
        docs.append((i, " ".join(words)))
    return items, docs, holds


def test_planted_items_are_found_and_clean_texts_left(spark):
    items, docs, holds = planted()
    extra = [(900, None), (901, ""), (902, " \n"), docs[0], (None, items[3][1])]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string").withColumn("contaminated", F.lit(True))
    df = spark.createDataFrame([*docs, *extra], "doc_id long, text string").withColumns({"item_id": F.lit(1), "__found": F.lit("clash"), "n_items": F.lit("x")})
    rows = [tuple(r) for r in D.mark(df, bench).collect()]
    assert len(rows) == len(docs) + len(extra)
    got = {r[0]: (r[1], r[3]) for r in rows}
    hit = [i for i, item in holds.items() if item in got[i][1]]
    sure = [i for i, item in holds.items() if plain_share(dict(items)[item], dict(docs)[i]) >= 0.8]
    assert set(sure) <= set(hit) and len(sure) > 50
    for i, doc in docs:
        if got[i][0] and i not in holds:
            assert max(plain_share(t, doc) for _, t in items) >= 0.6
    assert sum(got[i][0] for i, _ in docs if i not in holds) == 0
    assert got[None] == (True, [3]) and not got[900][0] and not got[901][0] and sum(r[0] == 0 for r in rows) == 2


def test_many_items_are_taken_in_blocks(spark):
    items, docs, holds = planted()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    few = {r["doc_id"]: r["item_ids"] for r in D.mark(df, bench, D.Settings(item_block=11)).collect()}
    assert sum(item in few[i] for i, item in holds.items()) >= 0.9 * len(holds)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = df.where("false").select(F.col("doc_id").alias("item_id"), "text")
    assert [r["contaminated"] for r in D.mark(df, none).collect()] == [False, False]
    assert D.mark(df.where("false"), df.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_items_of_own_words_in_many_blocks(spark):
    draw = random.Random(8)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(draw.choice([20, 30, 45]))) + f". y{i} z{i}") for i in range(100)]
    docs, holds = [], {}
    for i in range(200):
        words = text(draw, 150).split()
        holds[i], item = draw.choice(items)
        at = draw.randrange(len(words))
        words[at:at] = item.split()
        docs.append((i, " ".join(words)))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in D.mark(df, bench, D.Settings(fit_docs=20, item_block=20)).collect()}
    hit = sum(item in got[i] for i, item in holds.items())
    assert hit == len(holds), hit


def test_words_that_all_texts_have_count(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(i, item) for i in range(5)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert all(r["contaminated"] for r in D.mark(df, bench).collect())


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def brute_pairs(docs, items, s):
    """(doc, item) by every window against every item, without the latent space."""
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
    out = set()
    known = [(i, words(t), set(words(re.split(r"[.!?]\s", t.rstrip())[-1]))) for i, t in items if words(t)]
    for d, text in docs:
        w = words(text)
        for i, item, answer in known:
            size = 2 << max(0, round(math.log2(len(item) / 8)))
            half, bag = len(item) // 2, Counter(item)
            for first in range(0, len(w), size):
                near = w[max(0, first - half) : first + 4 * size + half]
                if sum((Counter(near) & bag).values()) < min(s.verbatim, s.paraphrase) * len(item):
                    continue
                share = plain_subsequence(item, near) / len(item)
                if share >= s.verbatim or share >= s.paraphrase and len(answer & set(near)) >= s.answer * len(answer):
                    out.add((d, i))
                    break
    return out


def test_recall_against_all_windows_and_items(spark):
    """The driver's documents against its benchmark: the cosine search loses no pair that the words confirm."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute_pairs([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()], D.Settings())
    found = {(r.doc_id, i) for r in D.mark(docs, bench).collect() for i in r.item_ids}
    assert found <= expected and len(found) >= 0.95 * len(expected) > 0


def test_very_long_texts_and_equal_shares(spark):
    draw = random.Random(3)
    items = [(i, text(draw, 30) + ". " + text(draw, 3)) for i in range(3)]
    long = text(draw, 120_000).split()
    for at, (_, item) in zip((10, 60_000, 119_990), items, strict=True):
        long[at:at] = item.split()
    docs = spark.createDataFrame([(1, " ".join(long)), (2, "x" * 2_000_000), (3, " ".join(t for _, t in items))], "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.best_share) for r in D.mark(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: ([0, 1, 2], 1.0), 2: ([], None), 3: ([0, 1, 2], 1.0)}


def plain_space(texts, weights, idf, rank):
    """The whitened feature vectors by a full SVD of the weighted TF-IDF passages."""
    rows = []
    for t, w in zip(texts, weights, strict=True):
        f = D._features(np.array(D._codes([t])[0], dtype=np.uint64))
        rows += [w * np.bincount(f[i : i + 32], minlength=D.DIMENSIONS) * idf for i in range(0, len(f), 32)]
    _, values, right = np.linalg.svd(np.array(rows), full_matrices=False)
    return right[:rank].T / values[:rank] * idf[:, None]


def test_the_space_is_fitted_on_every_text(spark):
    draw = random.Random(14)
    topics = [[f"t{k}w{j % (3 + k)}" for j in range(32)] for k in range(12)]
    texts = [" ".join(draw.sample(topics[min(11, i % 37)], 32)) for i in range(2600)]  # the words of a topic in any order
    texts += [texts[5]] * 300 + [" ".join(f"rare{j}" for j in range(32))] * 7
    df = spark.createDataFrame([*[(t,) for t in texts], (None,), ("",)], "text string")
    items = spark.createDataFrame([(0, texts[0])], "item_id long, text string")
    got = D.latent_space(df, items, D.Settings(rank=13), "text", "text")
    counts, n = D.document_frequencies(df, "text")
    once = list(dict.fromkeys(texts))
    want = plain_space([*once, texts[0]], [*[1.0] * len(once), D.Settings().items_weight], np.log1p((1 + n) / (1 + counts)), 13)
    used = np.flatnonzero(counts)
    got, want = got[used] @ got[used].T, want[used] @ want[used].T
    assert n == len(texts) + 2 and np.abs(got - want).max() < 0.001 * np.abs(want).max()


def test_rows_spread_to_features():
    draw = np.random.default_rng(5)
    y, padded = draw.standard_normal((40, 3), dtype=np.float32), np.where(draw.random(1280) < 0.3, 7, draw.integers(0, 90, 1280)).astype(np.int32)
    padded[draw.random(1280) < 0.1] = D.DIMENSIONS
    total, want = np.zeros((D.DIMENSIONS, 3)), np.zeros((D.DIMENSIONS + 1, 3))
    np.add.at(want, padded, y[np.arange(1280) // 32])
    D.spread(y, padded, 32, total)
    assert np.allclose(total, want[:-1], atol=1e-4)
    D.spread(y[:0], padded[:0], 32, total)
