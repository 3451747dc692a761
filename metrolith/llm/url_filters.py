"""URL filters: explicit host and path rules first, then association rules mined from labels by FP-growth.

URL tokens of labelled pages and their label are transactions; of the rules `tokens -> block`, those with enough
confidence, support and lift stay, without those that contain another one. An inverted index keyed by each rule's rarest
token meets the tokens of a URL, and the other tokens of the rule are then looked up in the URL's own. Everything runs
in Spark SQL and Spark ML; the verdict is worked out once per distinct URL that meets a rule.

All tokens of a page count. What would make sets of tokens many without making rules is left out of the baskets first, and
no rule is lost by that: tokens of fewer blocked pages than a rule needs; tokens that are a rule alone, as a wider rule
would contain it; and tokens that all pages that aren't blocked have, as a rule without such a token is as good. Tokens
that the very same pages have can stand for each other in every rule, so they are mined as one, their group. A rule has one
token of each of its groups; it is kept once, with its groups, not once for each choice. Sets of tokens that many blocked
pages have, each on slightly different pages, are still as many as there are.

Defined results: a null URL, or one without `://`, has an empty host and path, no tokens and the verdict allow; repeated
rows are judged row by row; an empty table gives an empty table; without labels there are no mined rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.llm.scratch import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
BLOCK = "verdict=block"


@dataclass(frozen=True)
class Settings:
    min_support: float = 0.002
    #: A rule stands on this many blocked pages at least, however few pages have labels.
    min_pages: int = 10
    min_confidence: float = 0.6
    min_lift: float = 1.5
    #: Rules up to this number are sent to every task; beyond it, the index is joined by shuffle.
    broadcast_rules: int = 10_000


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def listed(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), null where none fits; rules: (allow or block, `host/path`)."""
    rule = said = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return rule, said


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, marked by where they stand; numbers count as one token."""
    text = F.coalesce(url, F.lit(""))
    plain = lambda c: F.regexp_replace(c, r"^[0-9]+$", "0")
    pick = lambda mark, c, by: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))
    found = F.concat(
        pick("scheme=", F.regexp_extract(text, r"^([A-Za-z]+)://", 1), "/"),
        pick("host:", host(text), r"\."),
        pick("path:", path(text), r"[/._-]"),
        pick("query:", F.regexp_replace(F.regexp_extract(text, r"\?([^#]*)", 1), r"=[^&]*", ""), "&"),
        pick("mark:", F.regexp_extract(text, r"#(.*)$", 1), "/"),
    )
    return F.when(text.contains("://"), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame | None:
    """labelled: url, bad (boolean). Rules (rule, tokens, groups, key, confidence, support), or None if there are none.

    groups: for each token of the rule the tokens that may stand in its place, itself included; tokens has the first of each
    by name, key is the group of the fewest pages."""
    pages = labelled.where(F.col("bad").isNotNull()).select("bad", tokens(F.col("url")).alias("held"), F.monotonically_increasing_id().alias("page"))
    pages = cut(pages.where(F.col("bad") | (F.size("held") > 0)))
    n, n_bad = pages.agg(F.count("*"), F.count_if("bad")).first()
    if n < settings.min_pages or not n_bad:
        return None
    support = max(settings.min_support, settings.min_pages / n)
    least = max(settings.min_confidence, settings.min_lift * n_bad / n)
    each = pages.select("page", "bad", F.explode("held").alias("token"))
    same = [F.sum(F.xxhash64("page", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]  # equal sums: the same pages
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *same).where(F.col("n_bad") >= support * n - 1e-9)
    groups = counts.groupBy("n", "n_bad", "s0", "s1").agg(F.array_sort(F.collect_list("token")).alias("group")).select("n", "n_bad", "group", F.col("group")[0].alias("token"))
    groups = cut(groups)
    alone = F.col("n_bad") >= least * F.col("n") - 1e-9
    single = groups.where(alone).select(F.array("token").alias("tokens"), (F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / n).alias("support"))
    mined = groups.where(~alone & (F.col("n") - F.col("n_bad") < n - n_bad)).select("token")
    # At most tokens of a page / support rows, whatever the number of pages.
    held = each.join(F.broadcast(mined), "token").groupBy("page").agg(F.collect_list("token").alias("kept"))
    none = F.array().cast("array<string>")
    baskets = cut(pages.join(held, "page", "left").select(F.concat(F.coalesce("kept", none), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(none)).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=settings.min_confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.col("lift") >= settings.min_lift))
    rules = cut(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").unionAll(single).withColumn("rule", F.array_join("tokens", " ")))
    if rules.isEmpty():
        return None
    # A rule that holds another rule says nothing more: such a pair shares the smaller rule's first token.
    small = rules.select(F.col("tokens").alias("small"), F.col("tokens")[0].alias("token"))
    wider = rules.select("rule", "tokens", F.explode("tokens").alias("token")).join(small, "token").where((F.size("small") < F.size("tokens")) & (F.size(F.array_except("small", "tokens")) == 0))
    rules = rules.join(wider.select("rule").distinct(), "rule", "left_anti")
    ranked = rules.select("rule", F.explode("tokens").alias("token")).join(groups, "token")
    keys = ranked.groupBy("rule").agg(F.min_by("group", F.struct("n", "token")).alias("key"), F.array_sort(F.collect_list("group")).alias("groups"))
    return cut(rules.join(keys, "rule"))


def hits(urls: DataFrame, rules: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """__url, mined (the first rule by name): the distinct URLs in `__url` that meet a rule."""
    index = rules.select(F.explode("key").alias("token"), "groups", "rule")
    if rules.agg(F.sum(F.size("key"))).first()[0] <= settings.broadcast_rules:
        index = F.broadcast(index)
    held = urls.select("__url", tokens(F.col("__url")).alias("held")).select("__url", "held", F.explode("held").alias("token"))
    met = held.join(index, "token").where(F.forall("groups", lambda g: F.arrays_overlap(g, F.col("held"))))
    return met.groupBy("__url").agg(F.min("rule").alias("mined"))


def judge(pages: DataFrame, listed_rules: list[tuple[str, str]], rules: DataFrame | None, settings: Settings = Settings(), url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`keep`, host, path, rule (the listed rule or null), mined (the mined rule or null) and verdict."""
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").alias("__url"))
    if rules is None:
        rows = rows.withColumn("mined", F.lit(None).cast("string"))
    else:
        rows = rows.join(hits(rows, rules, settings), "__url", "left")
    own, rest = host(F.col("__url")), path(F.col("__url"))
    rule, said = listed(listed_rules, F.col("host"), F.col("path"))
    method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], own.alias("host"), rest.alias("path"), "mined")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(said, method)})
