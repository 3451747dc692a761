import hashlib
import random
import re
from collections import Counter

import pytest
from metrolith.llm import substring_dedup, suffix_dedup
from pyspark.sql import functions as F


def plain_words(rows, size=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (id_, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((id_, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(seed, n=60):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "the", "é", "日本", "of", "x y", "long-word", " "])
    passages = [" ".join(word() for _ in range(draw.choice([34, 35, 36, 60]))) for _ in range(6)]
    rows = [(i, draw.choice([" ", "\n", "\t\r", "\x0b\x0c "]).join([" ".join(word() for _ in range(draw.randrange(60))), draw.choice(passages), word(), draw.choice(["", draw.choice(passages)])])) for i in range(n)]
    edge = [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "one"), (n + 4, "re " * 34), (n + 5, "peat " * 36), (n + 6, rows[0][1]), (n + 6, rows[0][1]), (None, rows[1][1]), (n + 7, " ".join(f"w{i}" for i in range(40000)))]
    return rows + edge + [(n + 8, "tail"), (n + 9, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("clash"), "id": F.lit(0), "bucket": F.lit(None).cast("int")})
    out = sorted((tuple(r) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    assert out == plain_words(rows)


def test_words_match_brute_force_on_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert out == plain_words([tuple(r) for r in docs.collect()])


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_bytes(rows, size=50):
    data = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, d in data:
        for k in range(len(d) - size + 1):
            least[d[k : k + size]] = min(i, least.get(d[k : k + size], i))
    out = []
    for (i, d), (id_, _) in zip(data, rows, strict=True):
        gone = bytearray(len(d) + 1)
        for k in range(len(d) - size + 1):
            if least[d[k : k + size]] < i:
                gone[k : k + size] = b"\x01" * size
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(d)))
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((id_, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted_bytes(seed, n=60):
    draw = random.Random(seed)
    text = lambda k: "".join(draw.choice("ab é日\n\0") for _ in range(k))
    shared = [text(k) for k in (20, 25, 30, 49, 50, 51, 120, 400)]
    rows = [(n - i, text(draw.randrange(40)).join(draw.choice(shared) for _ in range(draw.randrange(5)))) for i in range(n)]
    edge = [(1000, None), (1001, ""), (1002, "x" * 49), (1003, "x" * 50), (1004, "x" * 51), (1005, "x" * 5000), (1006, "ab" * 70), (1006, "ab" * 70), (1007, "ba" * 60), (None, "ab" * 90), (None, "ab" * 90), (1008, "q" * 200000)]
    return rows + edge


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes_match_brute_force(spark, seed):
    rows = planted_bytes(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"block": F.lit("clash"), "id": F.lit(0)})
    out = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert out == plain_bytes(rows)


def test_bytes_match_brute_force_on_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert out == plain_bytes([tuple(r) for r in docs.collect()])
    assert suffix_dedup.remove_repeats(docs.where("false")).count() == 0


def test_intervals_are_the_common_prefixes():
    draw = random.Random(5)
    texts = list({bytes(draw.choice(b"ab\0") for _ in range(draw.randrange(8, 40))) for _ in range(200)})
    text, place, group = suffix_dedup.common_prefixes(texts, 8)
    strings = [texts[t][p : p + 8] for t, p in zip(text.tolist(), place.tolist(), strict=True)]
    assert len(strings) == sum(len(t) - 7 for t in texts)
    assert len(set(zip(strings, group.tolist(), strict=True))) == len(set(strings)) == len(set(group.tolist()))
