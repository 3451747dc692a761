import random
import re
from collections import Counter

import pytest
from metrolith.llm import near_dup as N
from pyspark.sql import functions as F


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def plain(rows, percent, k):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] and sets[i] and sets[j] or both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), id_), id_) if id_ is not None else None
    return sorted(((id_, len(sets[i]), least[root(i)], id_ is None or id_ == least[root(i)]) for i, (id_, _) in enumerate(rows)), key=str)


def planted(seed):
    draw = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{draw.randrange(300)}" for _ in range(draw.choice([6, 30, 120, 250]))]
        for _ in range(draw.randrange(1, 9)):
            text = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(1000)}"
            if draw.random() < 0.3:
                base = text  # a chain: each copy close to the last
            rows.append((0, draw.choice([" ", "\n"]).join(w.upper() if draw.random() < 0.2 else w for w in text)))
    rows = [(i * 3 % 1009, t) for i, (_, t) in enumerate(rows)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "two words"), (2006, "É a b"), (2007, "é a b"), (2008, "a b c a b c a b c"), (2009, "a b c a b c"), (None, rows[0][1]), (None, ""), rows[0], rows[1], (3000, "p q r s"), (3001, "k l m n"), (3001, "p q r s"), (3002, "k l m n"), (3002, "f g h i"), (3001, "")]


@pytest.mark.parametrize("seed,percent,k", [(1, 85, 3), (2, 80, 5)])
def test_components_match_brute_force(spark, seed, percent, k):
    rows = planted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "node": F.lit(1), "band": F.lit(1)})
    assert sorted((tuple(r) for r in N.find(df, percent, k).collect()), key=str) == plain(rows, percent, k)


def test_matches_brute_force_on_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in N.find(docs, 85, 3).collect()), key=str) == plain(rows, 85, 3)
    assert N.find(docs.where("false"), 85, 3).count() == 0


def edited(draw, base, most):
    """Each copy loses, gains or changes up to `most` words."""
    words = list(base)
    for _ in range(draw.randrange(most)):
        i = draw.randrange(len(words))
        words[i : i + 1] = draw.choice([[], [words[i], words[i]], [f"v{draw.randrange(40)}"]])
    return " ".join(words)


@pytest.mark.parametrize("percent,k", [(85, 3), (80, 5)])
def test_a_large_group_of_near_copies_matches_brute_force(spark, percent, k):
    draw = random.Random(percent)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = [(i * 7 % 1201, edited(draw, base, 20)) for i in range(600)]
    expected = plain(rows, percent, k)
    sizes = Counter(r[2] for r in expected)
    assert len(sizes) > 50 < max(sizes.values())
    assert sorted((tuple(r) for r in N.find(spark.createDataFrame(rows, "doc_id long, text string"), percent, k).collect()), key=str) == expected


def test_pairs_across_components_are_the_links(spark):
    """Without stars every class is a component of its own; the hubs must find all links, in pairs or through themselves."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(draw, base, 12)) for i in range(150)] + [(200 + i, edited(draw, [f"y{j}" for j in range(9)], 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string")
    banded = docs.select(F.lit(1).alias("band"), F.col("id").alias("node"))
    near = N._against_hubs(banded, spark.createDataFrame([], "node long, component long"), docs, 85, 3)
    direct = near.where("linked and component <> hub").selectExpr("node a", "hub b")
    labels = dict(N.components(N.confirm(direct.unionAll(N._across(near, 85)), docs, 85, 3)).collect())
    assert all(labels.get(i, i) == c for i, _, c, _ in plain(rows, 85, 3))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (202, 201)], "a long, b long")
    out = dict(N.components(edges).collect())
    assert set(out[i] for i in range(71)) == {0} and {out[200], out[201], out[202]} == {200}
