import re
from collections import Counter

import pytest
from metrolith.llm import quality_rules as Q

DATA = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [
    (900, None), (901, ""), (902, " \n\t\x0b\x0c\r "), (903, "one"), (904, "a b c d e f g h " * 4), (905, "x " * 40),
    (906, "a\n\na\n a\na"), (907, "é日本 \U0001f600 # * $ % & | < >"), (908, "a b c d e f g h i a b c d e f g h"), (908, "a b c d e f g h i a b c d e f g h"),
    (None, "w " * 30), (909, "long text " * 30000), (910, "\u00a0 no\u00a0break\u2003 x"),
]


def test_statistics_match_a_plain_count(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(ODD, "doc_id long, text string"))
    out = Q.statistics(docs.withColumnRenamed("text", "body"), "body", ("doc_id", "body")).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.body), r.doc_id


def test_rules_find_the_planted_threshold_and_keep_the_rest(spark):
    rows = [(i, ("#noise " if i % 4 == 0 else "plain ") + " ".join(f"w{(i * 7 + k) % 1000}" for k in range(30)) + (" ###" * 25 if i % 4 == 0 else ""), "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(300)] + [(1, 0), (None, 0), (5, None)], "doc_id long, quality int")
    rules = Q.learn(docs, labels)
    assert rules and len(rules[0]) <= 3
    out = {r.doc_id: r for r in Q.judge(docs, rules).collect()}
    assert all(out[i].kept == (i % 4 != 0) for i in range(300, 400))  # held out
    assert all((out[i].rule is None) == out[i].kept for i in range(400))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.learn(docs, none)
    assert rules == [] and Q.judge(docs.where("false"), rules).count() == 0
    assert Q.judge(docs, rules).first().base_failed


def test_held_out_accuracy(spark):
    """Rules learnt from half of the labels: they keep the other half's good rows and catch its bad ones. The smaller tables have
    too few bad rows beyond the base rules to learn from (18 in a half of those of sf0.01)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = Q.learn(docs, labels.where("doc_id % 2 = 0"))
    out = Q.judge(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in out if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and len(good) > 1000
    assert sum(not k for k in bad) >= 0.9 * len(bad) and len(bad) > 100, (sum(not k for k in bad), len(bad))
