"""Quality rules: a learned decision list over text statistics, as one ordered Spark conditional expression.

Sequential covering: a rule is grown one threshold condition at a time by information gain on two thirds of a bounded
sample of labelled documents, its last conditions are pruned on the other third, the rows it covers are set aside, and
the next rule is grown on the rest. The sample is reduced to counts of binned statistics; every growth step is one
aggregation of these counts, of which the driver sees one row per statistic and bin. Everything runs in Spark SQL.

Defined results: null text has no words (base_failed); repeated rows are judged row by row; an empty table gives an
empty table; labels that are null, or that contradict each other for one id, teach nothing; without bad labels there are
no rules, and only the base decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm.scratch import cut, let

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds the labelled rows that the rules are fitted on; bins, the thresholds tried for a statistic."""

    sample_rows: int = 20_000
    bins: int = 16
    max_rules: int = 8
    max_conditions: int = 3
    min_precision: float = 0.9
    min_covered: int = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float
    edge: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold

    def binned(self) -> Column:
        return F.col(f"bin_{self.feature}") > self.edge if self.at_least else F.col(f"bin_{self.feature}") <= self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _zip_shift(values: Column, by: int) -> Column:
    """Hash of each element with the one `by` places on, as far as there is one."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _repeated_words(hashes: Column) -> Column:
    """Words in 8-word windows that occur twice or more; hashes: one per word."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(placed, lambda z: F.filter(z, lambda s, i: F.coalesce(F.get(z, i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(F.get(z, i + 1)["h"] == s["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda s: s["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    windows = let(let(hashes, lambda h: _zip_shift(h, 1)), lambda h: let(_zip_shift(h, 2), lambda g: _zip_shift(g, 4)))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text, and the shares below."""
    t = F.col("__text")
    one = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    two = one.withColumns(
        {
            "__words": F.filter(F.split(t, SPACE), lambda w: w != ""),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "__lines": F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
            "__upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
            "__bangs": F.length(t) - F.length(F.translate(t, "!", "")),
        }
    )
    three = two.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        _repeated_words(F.transform("__words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
        F.size(F.array_distinct("__words")).alias("__n_distinct"),
        "__upper",
        "__bangs",
    )
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    shares = {
        "mean_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("__n_distinct") / words,
        "upper_share": F.col("__upper") / chars,
        "bang_share": F.col("__bangs") / words,
    }
    return three.withColumns(shares).drop("__n_lines", "__n_distinct", "__upper", "__bangs")


FEATURES = ("n_words", "mean_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "bang_share")


def _sample(labels: DataFrame, settings: Settings, key: str, quality: str) -> DataFrame:
    """About sample_rows ids at most, by the hash of the id, with bad = 1 for quality 0."""
    good = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull())
    share = min(1.0, settings.sample_rows / max(1, good.count()))
    some = good.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    return some.groupBy(F.col(key).alias("__id")).agg(F.min(quality).alias("low"), F.max(quality).alias("high")).where("low = high").select("__id", (F.col("low") == 0).cast("int").alias("bad"))


def learn(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id", quality: str = "quality") -> list[list[Condition]]:
    """The ordered rules; a document that fits all conditions of one is bad."""
    sample = F.broadcast(_sample(labels, settings, key, quality))  # at most about sample_rows pairs of numbers
    docs = df.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__t")).join(sample, "__id")
    rows = cut(statistics(docs, "__t", ("__id", "bad")))
    picks = [F.percentile_approx(f, [i / settings.bins for i in range(1, settings.bins)], 10_000).alias(f) for f in FEATURES]
    quantiles = rows.agg(*picks).first()
    edges = {f: sorted({float(x) for x in quantiles[f] or []}) for f in FEATURES}
    for f in FEATURES:  # the smallest value above a common zero is a threshold of its own
        if edges[f] == [0.0]:
            edges[f] = [1e-9]
    binned = [F.lit(0) + sum(((F.col(f) >= e).cast("int") for e in edges[f]), F.lit(0)) for f in FEATURES]
    fold = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(3)) < 2
    cells = rows.select("bad", fold.alias("grow"), *[b.alias(f"bin_{f}") for f, b in zip(FEATURES, binned, strict=True)]).groupBy("bad", "grow", *[f"bin_{f}" for f in FEATURES]).count()
    left, rules = cut(cells.coalesce(1)), []
    for _ in range(settings.max_rules):
        rule = _grow(left, edges, settings)
        if not rule:
            break
        rules.append(rule)
        left = left.where(~_all(c.binned() for c in rule))
    return rules


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _counts(cells: DataFrame) -> dict[str, dict[int, list[int]]]:
    """statistic -> bin -> [bad, good] of the growing part, then of the pruning part."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES]))
    n = {(bad, grow): F.sum(F.when((F.col("bad") == bad) & (F.col("grow") == grow), F.col("count")).otherwise(0)) for grow in (True, False) for bad in (1, 0)}
    found = cells.select("bad", "grow", "count", stack.alias("s")).groupBy("s.f", "s.b").agg(*[c.alias(f"n{i}") for i, c in enumerate(n.values())]).collect()
    out: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
    for r in found:
        out[r["f"]][r["b"]] = [r[f"n{i}"] for i in range(4)]
    return out


def _grow(cells: DataFrame, edges: dict[str, list[float]], settings: Settings) -> list[Condition] | None:
    rule: list[Condition] = []
    steps: list[tuple[int, int]] = []  # bad and good of the pruning part, after each condition
    for _ in range(settings.max_conditions):
        counts = _counts(cells.where(_all(c.binned() for c in rule)))
        totals = [sum(v[i] for v in counts[FEATURES[0]].values()) for i in range(4)]
        if not totals[0] or not totals[1]:
            break
        prior, best = math.log2(totals[0] / (totals[0] + totals[1])), None
        for f in FEATURES:
            for edge, threshold in enumerate(edges[f]):
                above = [sum(v[i] for b, v in counts[f].items() if b > edge) for i in range(4)]
                for at_least, n in ((True, above), (False, [t - a for t, a in zip(totals, above, strict=True)])):
                    if n[0] >= settings.min_covered and (gain := n[0] * (math.log2(n[0] / (n[0] + n[1])) - prior)) > (best[0] if best else 1e-9):
                        best = gain, Condition(f, at_least, threshold, edge), n
        if best is None:
            break
        rule.append(best[1])
        steps.append((best[2][2], best[2][3]))
    worth = [(bad - good) / max(1, bad + good) for bad, good in steps]
    while len(rule) > 1 and worth[-2] >= worth[-1]:
        rule.pop()
        steps.pop()
        worth.pop()
    if not rule or steps[-1][0] < settings.min_covered or steps[-1][0] < settings.min_precision * sum(steps[-1]):
        return None
    return rule


def verdict(rules: list[list[Condition]]) -> Column:
    """The first rule that fits, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(c.column() for c in rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(df: DataFrame, rules: list[list[Condition]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """`keep`, the statistics, base_failed, rule (the learned rule that fits, else null) and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    judged = statistics(df, text, keep).withColumns({"base_failed": failed, "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
