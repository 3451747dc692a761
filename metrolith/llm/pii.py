"""Personal data: base patterns, and bootstrapped contextual extraction on top.

One scan of the texts finds the base entities (e-mail, IP, card, phone) and all other candidate identifiers, tokens with
a digit, with the words around each. Entities are seeds: patterns and values form a graph, in which Spark scores a pattern
by the share of its values that are known, then a value by the patterns it stands in, in turn, for some rounds. Patterns
are the two words before, the word before, the word before with the shape of the token, and the word after. A pattern
counts if it holds several different values that are entities or were found with confidence in an earlier round, so what
is found spreads. All places of a value of high confidence, whatever stands around them, are spans of kind `other`.

Defined results: null text counts as empty (no spans, the digest of nothing); repeated rows have equal results; a null id
is a row like any other; an empty table gives an empty table; other columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolith.llm.scratch import cut

#: The base patterns, in the order in which kinds are listed.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "other")

_local = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits matches from its first digit or not at all, so the look-behind only saves repeated tries.
_ip = re.compile(r"(?<![0-9])" + IP)
_card = re.compile(CARD)
_phone = re.compile(PHONE)
_digits = re.compile(r"[0-9]+")
_token = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._+-/")

_candidate = "array<struct<context:string,value:string,begin:int,end:int,seed:boolean,after:string>>"


@dataclass(frozen=True)
class Settings:
    """What the method adds is found among tokens of `shortest` to `longest` characters, by words that stand within `reach`
    characters before or behind; base spans have no such bounds."""

    shortest: int = 6
    longest: int = 64
    reach: int = 80
    rounds: int = 3
    min_seeds: int = 3
    min_confidence: float = 0.8
    prior: float = 1.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _local:
            begin -= 1
        if begin < at and (m := _domain.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in code points, by kind as listed and then by begin."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _digits.search(text):
        return out
    for m in _ip.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := re.sub("[ -]", "", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _context(text: str, begin: int, reach: int) -> str:
    """The two words before, in lower case, digits as 0."""
    words = text[max(0, begin - reach) : begin].lower().split()[-2:]
    return re.sub("[0-9]", "0", " ".join(words))


def _after(text: str, end: int, reach: int) -> str:
    """The word after, in lower case, digits as 0."""
    return re.sub("[0-9]", "0", " ".join(text[end : end + reach].lower().split()[:1]))


def candidates(text: str, base: list[tuple[str, int, int]], settings: Settings = Settings()) -> list[tuple[str, str, int, int, bool, str]]:
    """(context, value, begin, end, seed, after) of the base entities and of all other tokens with a digit."""
    out, taken, done = [], sorted((b, e) for _, b, e in base), 0
    for b, e in taken:
        out.append((_context(text, b, settings.reach), text[b:e], b, e, True, _after(text, e, settings.reach)))
    i = 0
    for m in _digits.finditer(text):
        if m.start() < done:
            continue
        begin, end = m.span()
        while begin > done and text[begin - 1] in _token and end - begin <= settings.longest:
            begin -= 1
        while end < len(text) and text[end] in _token and end - begin <= settings.longest:
            end += 1
        done = end
        while end > begin and text[end - 1] in "._+-/@":
            end -= 1
        while begin < end and text[begin] in "._-/@":
            begin += 1
        while i < len(taken) and taken[i][1] <= begin:
            i += 1
        if any(b < end and begin < e for b, e in taken[max(0, i - 1) : i + 3]) or not settings.shortest <= end - begin <= settings.longest:
            continue
        out.append((_context(text, begin, settings.reach), text[begin:end], begin, end, False, _after(text, end, settings.reach)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), settings: Settings = Settings()) -> DataFrame:
    """`keep`, row (a hash of what is kept and the text), base (the base spans joined), and found, the candidates."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], _row(keep, text).alias("row"), F.col(f"`{text}`").alias("__text"))
    more = [T.StructField("base", T.StringType()), T.StructField("found", T._parse_datatype_string(_candidate))]
    schema = T.StructType([*source.schema.fields[:-1], *more])
    kind = pa.list_(pa.struct([("context", pa.string()), ("value", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("context", "value", "begin", "end", "seed", "after")
        for batch in batches:
            bases, found = [], []
            for value in batch.column(batch.num_columns - 1):
                t = value.as_py() or ""
                base = base_spans(t)
                bases.append(joined(base))
                found.append([dict(zip(names, c, strict=True)) for c in candidates(t, base, settings)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bases, pa.string()), pa.array(found, kind)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _row(keep: tuple[str, ...], text: str) -> Column:
    """128 bits of what is kept and the text, as two hashes that begin differently: equal rows have equal spans anyway, and of
    other rows no two are alike in any corpus that can be stored."""
    half = lambda begin: F.hex(F.xxhash64(F.lit(begin), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"), F.lit("row")))
    return F.concat_ws("-", half("one"), half("two"))


def _patterns() -> Column:
    """The patterns of a candidate f: a kind and what it says; the longest context first."""
    word, shape = F.substring_index("f.context", " ", -1), F.regexp_replace(F.regexp_replace(F.regexp_replace("f.value", "[0-9]", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    one = F.when(F.col("f.context") != "", F.array(F.concat(F.lit("2 "), "f.context"), F.concat(F.lit("1 "), word), F.concat(F.lit("s "), word, F.lit(" "), shape)))
    after = F.when(F.col("f.after") != "", F.array(F.concat(F.lit("a "), "f.after")))
    return F.concat(F.coalesce(one, F.array().cast("array<string>")), F.coalesce(after, F.array().cast("array<string>")))


def _least_share(w: str, n: str) -> Column:
    """The lower end of Wilson's interval of 95 % for w of n."""
    z, p = 1.96, F.col(w) / F.col(n)
    return (p + z * z / (2 * F.col(n)) - z * F.sqrt(p * (1 - p) / F.col(n) + z * z / (4 * F.col(n) * F.col(n)))) / (1 + z * z / F.col(n))


def confident_values(scanned: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """value, weight: the values that aren't entities and are taken for personal data.

    The two words before count what is likely too. The patterns that say less count only what is sure, and score by the
    lower bound of their share: where most identifiers are entities, a common word has a high share by chance."""
    edges = scanned.select(F.explode("found").alias("f")).select(F.explode(_patterns()).alias("pattern"), "f.value", "f.seed")
    edges = cut(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    long = F.col("pattern").startswith("2 ")
    sure = F.col("weight") >= settings.min_confidence
    known = edges.withColumn("weight", F.col("seed").cast("double"))
    for _ in range(settings.rounds):
        by_pattern = known.groupBy("pattern").agg(F.sum(F.when(long | sure, F.col("weight")).otherwise(0.0)).alias("w"), F.count("*").alias("n"), F.count_if(sure).alias("support"))
        scores = cut(by_pattern.where(F.col("support") >= settings.min_seeds).select("pattern", F.when(long, F.col("w") / (F.col("n") + settings.prior)).otherwise(_least_share("w", "n")).alias("score")).where("score >= 0.5"))
        doubt = F.sum(F.when(long, F.log1p(-F.least("score", F.lit(0.999)))).otherwise(0.0))
        found = edges.join(scores, "pattern").groupBy("value").agg(doubt.alias("doubt"), F.max(F.when(long, 0.0).otherwise(F.col("score"))).alias("best"))
        found = cut(found.select("value", F.greatest(1 - F.exp("doubt"), "best").alias("found")))
        known = cut(edges.join(found, "value", "left").select("pattern", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("weight")))
    return known.where(~F.col("seed") & sure).groupBy("value").agg(F.max("weight").alias("weight"))


def extract(df: DataFrame, settings: Settings = Settings(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, row, n_email, n_ip, n_card, n_phone, n_other, base_sha256 and spans, `kind:begin:end` joined by commas."""
    scanned = cut(scan(df, text, keep, settings))
    values = confident_values(scanned, settings)
    other = scanned.where(F.exists("found", lambda f: ~f["seed"])).select("row", F.explode("found").alias("f")).where("not f.seed").select("row", F.col("f.value").alias("value"), F.col("f.begin").alias("begin"), F.col("f.end").alias("end"))
    added = other.join(values, "value", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("added"))
    both = scanned.join(added, "row", "left")
    extra = F.coalesce(F.array_join(F.transform("added", lambda a: F.concat_ws(":", F.lit("other"), a["begin"], a["end"])), ","), F.lit(""))
    count = lambda kind: F.size(F.filter(F.split("base", ","), lambda s: s.startswith(kind + ":"))).cast("long")
    return both.select(
        *[F.col(f"`{c}`") for c in keep],
        "row",
        *[count(k).alias(f"n_{k}") for k in KINDS[:-1]],
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_other"),
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(extra != "", extra)).alias("spans"),
    )


def masked(text: str, spans: str) -> str:
    """The text with each span, or group of spans that overlap, as one mark of the first one's kind."""
    out, done = [], 0
    for begin, end, kind in sorted((int(b), -int(e), k) for k, b, e in (s.split(":") for s in spans.split(",") if s)):
        if begin >= done:
            out += [text[done:begin], f"[{kind.upper()}]"]
        done = max(done, -end)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows and columns of df, with marks in place of all spans."""
    spans = extract(df, settings, text, (key,)).where("spans <> ''").select(F.col("row").alias("__pii_row"), F.col("spans").alias("__pii_spans")).distinct()
    both = df.withColumn("__pii_row", _row((key,), text)).join(spans, "__pii_row", "left").select(*[df[c] for c in df.columns], "__pii_spans")
    names, place = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, spans = batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            new = pa.array([masked(v, s) if s else v for v, s in zip(values, spans, strict=True)], pa.string())
            columns = [new if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, df.schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
