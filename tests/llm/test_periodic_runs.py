import hashlib
import random
import re
import zlib

import pytest
from metrolith.llm import periodic_runs, registry
from pyspark.sql import functions as F


def plain(w, least=6, exponent=4):
    """Every period on its own: the longest stretches that agree with themselves one period on."""
    least_period = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                least_period.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in least_period.items()), key=lambda r: (r[0], r[2]))


def made(draw):
    """Cycles, earlier pieces again, and noise over few words."""
    letters, w = draw.choice([1, 2, 2, 3, 5]), []
    for _ in range(draw.randrange(1, 8)):
        kind = draw.random()
        if kind < 0.6:
            w += [draw.randrange(letters) for _ in range(draw.randrange(1, 6))] * draw.randrange(1, 9)
            w = w[: len(w) - draw.randrange(3)]
        elif w and kind < 0.85:
            at = draw.randrange(len(w))
            w += w[at : at + draw.randrange(1, 60)]
        else:
            w += [draw.randrange(letters) for _ in range(draw.randrange(1, 10))]
    return [f"w{x}" for x in w]


@pytest.mark.parametrize("least,exponent", [(2, 2), (4, 3), (6, 4)])
def test_runs_match_brute_force(least, exponent):
    draw, n = random.Random(exponent), 0
    for _ in range(4000):
        w = made(draw)
        expected = plain(w, least, exponent)
        assert periodic_runs.search([x.encode() for x in w], least, exponent) == expected, w
        number = {}
        whole = periodic_runs.runs_of([number.setdefault(x, len(number)) for x in w], least, exponent)
        assert sorted(((s, e - s, q) for s, e, q in whole), key=lambda r: (r[0], r[2])) == expected, w  # without cutting at rare pairs
        n += len(expected)
    assert n > 4000


def test_factors_are_the_longest_that_began_earlier():
    draw = random.Random(9)
    for _ in range(300):
        w = [draw.randrange(3) for _ in range(draw.randrange(40))]
        at = 0
        for start, length, source in periodic_runs.factors(w):
            earlier = lambda n: any(w[i : i + n] == w[at : at + n] for i in range(at)) and at + n <= len(w)  # noqa: B023, E731
            assert start == at and (not earlier(1) if source < 0 else w[source : source + length] == w[at : at + length] and source < at)
            assert source < 0 or not earlier(length + 1)
            at += length
        assert at == len(w)


def test_long_texts_take_linear_time():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 100_000:
        a, b = b, b + a
    assert periodic_runs.search(b) == []  # a Fibonacci word has exponents below four
    assert periodic_runs.search([b"x"] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.search([b"w%d" % (i % 7919) for i in range(100_000)]) == [(0, 100_000, 7919)]


def test_rows_of_any_kind(spark):
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b c"), (5, "x " * 6), (5, "x " * 6), (None, "a b " * 4 + "c"), (6, "no cut\u0085 " * 7), (7, " ".join(f"{i} {i}" for i in range(40_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "collapsed": F.lit(1), "__text": F.lit(2)})
    out = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find(docs).collect()))
    long = rows[-1][1]
    assert out == [(0, 9, [(0, 8, 2)], "a b c"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 3, [], "a b c"), (5, 6, [(0, 6, 1)], "x"), (5, 6, [(0, 6, 1)], "x"), (6, 7, [(0, 7, 1)], "no cut\u0085"), (7, 80_000, [], long)]
    assert periodic_runs.find(docs.where("false")).count() == 0


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_over_the_driver_table(spark):
    out = registry.queries()["op11_periodic_runs"](spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 20000").collect()
    rows = {r.doc_id: tuple(r) for r in out.collect()}
    assert len(rows) == 200 and len(docs) > 180
    expected = {d.doc_id: contract(d.doc_id, d.text) for d in docs}
    assert {i: rows[i] for i in expected} == expected and sum(r[1] > 0 for r in expected.values()) > 5


def test_planted_cycles(spark):
    """Small texts of all kinds through the query's own words."""
    draw = random.Random(4)
    rows = [(i, draw.choice([None, "", " ", "one"]) if i % 50 == 0 else " ".join(made(draw))) for i in range(1500)] + [(None, "a a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_words, len(r.runs)) for r in periodic_runs.find(registry.with_cycles(docs)).collect()}
    for i, t in rows[:-1]:
        assert found[i] == (len((t or "").split()), contract(i, t)[1])
    assert found[None] == (6, 1)
