import math
import hashlib
import random
import re

import pytest
from metrolith.llm import pii
from pyspark.sql import functions as F

RULES = [("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)]


def plain(text):
    out = []
    for kind, pattern in RULES:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and pii.luhn("79927398713") and not pii.luhn("79927398710")


def test_base_spans_match_the_plain_patterns():
    draw = random.Random(4)
    for letters in ("a@.b1-_%+ é", "0123.4 5-", "+(1) 234-.", "1234 56-7890", "@@..a-_b"):
        for _ in range(3000):
            t = "".join(draw.choice(letters) for _ in range(draw.randrange(60)))
            assert pii.base_spans(t) == plain(t), t
    for t in ("4111 1111 1111 1111", "x 4111-1111-1111-1111.", "001.002.003.255", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "+1 (234) 555-0000", "1" * 50000, "a" * 50000, "a@" * 20000):
        assert pii.base_spans(t) == plain(t), t[:50]


def test_driver_table_matches_and_columns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "q@w.com q@w.com"), (9003, "q@w.com q@w.com"), (None, "a@b.cd")], "doc_id long, text string")
    docs = docs.union(odd).withColumns({"row": F.lit("clash"), "found": F.lit(1), "base": F.lit(2)})
    out = pii.extract(docs, keep=("doc_id", "text")).collect()
    assert len(out) == docs.count()
    for r in out:
        base = plain(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() == pii.digest(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k, _ in RULES)
        assert r.spans.startswith(pii.joined(base)) and r.spans.count("other:") == r.n_other


def test_contexts_of_seeds_find_other_identifiers(spark):
    rows = [(i, f"word{i % 7} please call me under +1 234 555 {1000 + i} thanks") for i in range(30)]
    rows += [(100, "please call me under 555-77-8899 thanks"), (101, "a number 555-77-8800 alone"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__row", F.lit("clash"))
    out = {r.doc_id: r for r in pii.extract(docs).collect()}
    assert out[100].spans == "other:21:32" and out[101].spans == "" and out[5].n_phone == 1
    masked = {r.doc_id: r.text for r in pii.redact(docs.drop("__row")).collect()}
    assert masked[100] == "please call me under [OTHER] thanks" and masked[101] == rows[31][1] and masked[102] is None
    assert masked[5] == "word5 please call me under [PHONE] thanks"
    assert pii.extract(docs.where("false")).count() == 0 and pii.redact(docs.drop("__row").where("false")).count() == 0


def test_masked_joins_overlapping_spans():
    assert pii.masked("ab 1234 cd", "card:3:7,other:2:6") == "ab[OTHER] cd"
    assert pii.masked("x", "") == "x"


def test_what_is_found_spreads(spark):
    ids = [f"zk-{i:02}-77-{100 + i}" for i in range(25)]
    rows = [(i, f"word{i % 7} call me under +1 234 555 {1000 + i} thanks") for i in range(200)]
    rows += [(300 + i, f"call me under {v} thanks") for i, v in enumerate(ids[:20])]  # found beside the seeds
    rows += [(400 + i, f"my staff badge {v} today") for i, v in enumerate(ids)]  # a context without any seed: five more
    rows += [(500, f"{ids[0]}"), (501, f"odd words here {ids[24]} stand"), (502, "odd words here qq-12-34-567 stand")]
    out = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[300 + i].n_other == 1 for i in range(20)) and all(out[400 + i].n_other == 1 for i in range(25))
    assert out[500].spans == "other:0:12" and out[501].n_other == 1 and out[502].n_other == 0


def plain_values(found, s):
    """The scoring of patterns and values over a plain graph. found: (context, value, seed, after) of all candidates."""
    edges = {}
    for context, value, seed, after in found:
        word = context.split(" ")[-1]
        shape = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]", "0", value)))
        for pattern in ([f"2 {context}", f"1 {word}", f"s {word} {shape}"] if context else []) + ([f"a {after}"] if after else []):
            edges[pattern, value] = edges.get((pattern, value), False) or seed
    weight = {e: float(seed) for e, seed in edges.items()}
    for _ in range(s.rounds):
        score = {}
        for pattern in {p for p, _ in edges}:
            own = [w for (p, _), w in weight.items() if p == pattern]
            long, n = pattern.startswith("2 "), len(own)
            w = sum(x for x in own if long or x >= s.min_confidence)
            if sum(x >= s.min_confidence for x in own) < s.min_seeds:
                continue
            p, z = w / n, 1.96
            least = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if (value := w / (n + s.prior) if long else least) >= 0.5:
                score[pattern] = value
        told = {}
        for (pattern, value), _ in edges.items():
            if pattern in score:
                doubt, best = told.get(value, (1.0, 0.0))
                told[value] = (doubt * (1 - min(score[pattern], 0.999)), best) if pattern.startswith("2 ") else (doubt, max(best, score[pattern]))
        weight = {e: 1.0 if edges[e] else max(1 - told[e[1]][0], told[e[1]][1]) if e[1] in told else 0.0 for e in edges}
    return {v: w for (p, v), w in weight.items() if not edges[p, v] and w >= s.min_confidence}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_match_a_plain_graph(spark, seed):
    draw = random.Random(seed)
    leads = ["please call me", "my number is", "write to", "badge no", "order", "see page", "id"]
    values = [f"{draw.choice('ABC')}{draw.randrange(100)}-{draw.randrange(1000, 9999)}" for _ in range(25)]
    phone = lambda: f"+1 {draw.randrange(200, 999)} 555 {draw.randrange(1000, 9999)}"
    rows = []
    for i in range(300):
        k = draw.randrange(len(leads))  # what stands behind some words is mostly a number, behind others mostly a value of their own
        what = phone() if draw.random() < (0.9 if k < 3 else 0.1) else draw.choice(values[k::3])
        rows.append((i, f"{draw.choice(['', 'so '])}{leads[k]} {what} {draw.choice(['thanks', 'today', ''])}"))
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [(f.context, f.value, f.seed, f.after) for r in scanned.collect() for f in r.found]
    for settings in (pii.Settings(), pii.Settings(min_confidence=0.6, min_seeds=2, rounds=2)):
        expected = plain_values(found, settings)
        got = {r.value: r.weight for r in pii.confident_values(scanned, settings).collect()}
        assert 0 < len(expected) < len(values) and got.keys() == expected.keys() and all(abs(got[v] - expected[v]) < 1e-9 for v in got)
