"""HTML extraction: the main text of pages, less what most pages of their host repeat.

A small reader cuts a page into blocks. Blocks of article or main elements are the text, without the menus, notices,
forms and comments in them; pages that have no such element give all blocks that markup doesn't rule out. Then the host
decides about the blocks of every page: a repeat of LONG tokens or more that `share` of the different pages of the host
have, and LEAST at least, is boilerplate. A token is covered by such a repeat exactly if it is covered by a window of
LONG tokens that so many pages have, so windows stand for the maximal repeats, and runs of windows for their union.
Blocks that are mostly covered go; of other blocks only a run at an end goes, never words between others. Of an article only
short blocks go, and no page loses more than half, so an article that a host shows on several pages stays on all of them.

Windows are counted exactly in two passes: a window that has its share of the host has it in some chunk of the input too,
so a first pass names those and a second one, if there are any, counts them over all pages. No text is shuffled and no host meets one task.

Defined results: null and empty html give an empty text; a null url is a host of its own for each page, so nothing there
is repeated; pages of a host with equal blocks count as one page; repeated rows have equal results; an empty table gives
an empty table; other columns are dropped unless named in `keep`.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrolith.llm import blocks as B
from metrolith.llm.scratch import cut
from metrolith.llm.substring_dedup import Words
from metrolith.llm.url_filters import host

#: Tokens of a run that is long enough to be boilerplate; the share of a host's pages, and the least number, that have it.
LONG, SHARE, LEAST = 6, 0.5, 3
#: The share of a block that is covered when all of it goes; tokens that are counted at a time, less than twice as many
#: at most; windows that are broadcast.
MOSTLY, CHUNK, BROADCAST = 0.8, 1 << 21, 1_000_000
#: Tokens of the longest block of an article that repeats may take, and the largest share of a page that they may.
SHORT, LARGEST = 40, 0.5
GAP = np.zeros(256, dtype=bool)
GAP[[0x0A, 0x20]] = True

BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
SPACES = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head nav footer aside form button select iframe dialog template noscript svg object canvas audio video menu datalist".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Words of a class, id or role that mark what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation navigations newsletter notice notices notification pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Elements of an article whose class, id or role may mark them as no part of it; a paragraph, a heading or a list item of an
#: article belongs to it, but an item that holds a comment. Words that begin a class which tells of what a wrapper has or lacks, not of what it is.
CONTAINERS = frozenset("div section aside nav footer header form ul ol figure table iframe details article main".split())
ITEMS = frozenset("li dd dt tr td".split())
TELLING = frozenset("no has with without is not".split())

#: Text up to a tag, the slash of an end tag, the name and the attributes.
_tag = re.compile(r"""([^<]*+)<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*"|'[^']*')*+)>""")
_attribute = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_words = re.compile(r"[A-Za-z]+")


class _Open:
    """An open element: its name, whether it hides its content, whether it is an article, and whether words of its attributes
    alone hide it that aren't words of comments."""

    __slots__ = ("name", "hides", "article", "worded")

    def __init__(self, name: str, hides: str, article: bool, worded: bool):
        self.name, self.hides, self.article, self.worded = name, hides, article, worded


def _marked(attributes: str, words: str) -> str:
    """comment or other if the attributes mark an element as not part of the article, else nothing. words: which words of
    attributes count, "all", those of "comment"s, or "none"; what isn't shown always counts."""
    if not attributes:
        return ""
    if words != "none":
        found = set()
        for m in _attribute.finditer(attributes):
            for name in (m.group(2) or m.group(3) or m.group(4) or "").lower().split():
                parts = _words.findall(name)
                if parts and parts[0] not in TELLING:
                    found.update(parts)
        if found & COMMENTS:
            return "comment"
        if words == "all" and found & MARKS:
            return "other"
    return "other" if _hidden.search(attributes) else ""


_marked_before = lru_cache(maxsize=1 << 13)(_marked)
#: Attributes up to this length are remembered.
REMEMBERED = 200


def blocks(page: str) -> tuple[list[str], list[str]]:
    """(blocks of articles, other blocks that aren't ruled out), white space reduced and references decoded.

    Words in attributes rule out an article's containers only where at least half of the article is left; else only those
    that mark comments count. If they rule out all there is on a page, none count, so such words never empty a page."""
    main, rest, worded = _blocks(page, "all")
    if worded and (main or not rest):
        other, rest_too, _ = _blocks(page, "comment")
        if sum(map(len, other)) > 2 * sum(map(len, main)):
            main, rest = other, rest_too
    return (main, rest) if main or rest else _blocks(page, "none")[:2]


def _blocks(page: str, words: str) -> tuple[list[str], list[str], bool]:
    """(blocks of articles, other blocks, whether the former may be others if only words of comments count).

    Outside articles such words decide about other blocks only, unless an article begins inside the element that has them."""
    main: list[str] = []
    open_blocks: list[str] = []
    stack: list[_Open] = []
    buffer: list[str] = []
    hidden, in_article, doubt = "", 0, False

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(buffer)).split()):
            (main if in_article else open_blocks).append(text)
        buffer.clear()

    def state() -> tuple[str, int]:
        hides = next((x.hides for x in stack if x.hides), "")
        return hides, sum(x.article for x in stack)

    def mark(attributes: str, words: str) -> str:
        return (_marked_before if len(attributes) <= REMEMBERED else _marked)(attributes, words)

    at, size = 0, len(page)
    lowered = None
    while at < size:
        m = _tag.match(page, at)
        if not m:
            lt = page.find("<", at)
            if lt < 0:
                lt = size
            if lt > at and not hidden:
                buffer.append(page[at:lt])
            if lt == size:
                break
            at = lt
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            elif re.match(r"<[a-zA-Z]", page[at : at + 2]) and (page.find(">", at) < 0):
                at = size  # the page ends inside a tag
            elif re.match(r"<[a-zA-Z]", page[at : at + 2]):
                at = page.find(">", at) + 1  # quotes that don't close
            else:
                if not hidden:
                    buffer.append("<")
                at += 1
            continue
        text, slash, name, attributes = m.groups()
        at, name = m.end(), name.lower()
        if text and not hidden:
            buffer.append(text)
        if not slash and name in RAW:
            lowered = lowered if lowered is not None else page.lower() if len(page.lower()) == size else page
            end = lowered.find("</" + name, at)
            at = size if end < 0 else (page.find(">", end) + 1 or size)
            continue
        if name in BLOCKS:
            if buffer:
                flush()
        elif name in SPACES and not hidden:
            buffer.append(" ")
        if not slash:
            if name in VOID or attributes.endswith("/"):
                continue
            if name == "p":  # a paragraph ends the one before it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == "p":
                        del stack[i:]
                        hidden, in_article = state()
                        break
                    if stack[i].name in BLOCKS:
                        break
            article = name in ("article", "main")
            marked, worded = "", False
            if attributes:
                belongs = in_article and name not in CONTAINERS
                count = words if not belongs else "comment" if name in ITEMS and words != "none" else "none"
                marked = mark(attributes, count)
                worded = count == "all" and marked == "other" and name not in ("html", "body") and not mark(attributes, "comment")
            if worded and (in_article or article) or article and any(x.worded for x in stack):
                doubt = True
            if article and not marked and hidden and hidden != "comment":
                if buffer:
                    flush()
                while stack and state()[0]:  # a menu or notice that was never closed
                    stack.pop()
                hidden, in_article = state()
            hides = marked if name not in ("html", "body") and marked else "other" if name in HIDDEN or name == "header" and not in_article else ""
            if article and marked == "other":
                hides = ""
            stack.append(_Open(name, hides, article and not hides, worded))
            hidden = hidden or hides
            in_article += article and not hides
        elif stack and stack[-1].name == name:
            last = stack.pop()
            if last.hides or last.article:
                hidden, in_article = state()
        else:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), -1)
            if depth < 0:
                continue
            if any(x.article or x.hides and x.name in HIDDEN for x in stack[depth + 1 :]) and name not in ("body", "html", "article", "main"):
                continue  # a stray end tag doesn't close what holds it
            del stack[depth:]
            hidden, in_article = state()
    if buffer:
        flush()
    return main, open_blocks, doubt


def read_pages(df: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep`, __host (a hash, null without url), __article (whether an article was found) and __text, the blocks that markup
    leaves, one in a line."""
    own = F.when(F.col(f"`{url}`").isNotNull(), F.xxhash64(host(F.col(f"`{url}`"))))
    source = df.select(*[F.col(f"`{c}`") for c in keep], own.alias("__host"), F.col(f"`{html}`").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__article", T.BooleanType()), T.StructField("__text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, article = [], []
            for value in batch.column(batch.num_columns - 1):
                main, rest = blocks(value.as_py() or "")
                texts.append("\n".join(main or rest))
                article.append(bool(main))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(article), pa.array(texts, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _windows(texts: list[str], hosts: list[int], long: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(place in texts, number of tokens, code of each window of `long` tokens, which holds the host)."""
    table = pa.table({"id": pa.array(np.arange(len(texts))), "text": pa.array(texts, pa.string())})
    for part in B.slices(table):
        words = Words(part, GAP, lanes=1)
        runs = words.sums(0).runs(long)
        for i, first, end in zip(part.ids.tolist(), words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
            codes = runs[first : max(first, end - long + 1)]
            yield i, end - first, B.mix(codes ^ np.uint64(hosts[i] % 2**64)).view(np.int64)


def _counted(pages: DataFrame, long: int, share: float, wanted=None) -> DataFrame:
    """host, code, weight (different pages) for each chunk of pages: of the broadcast codes, or of those with `share` there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        owner: list[tuple[int, float]] = []
        size = at = at_size = 0

        def flush(until: int) -> pa.RecordBatch:
            n = [len(c) for c in codes[:until]]
            hosts, weights = np.array([h for h, _ in owner[:until]], dtype=np.int64), np.array([w for _, w in owner[:until]])
            every, page = np.concatenate(codes[:until]), np.repeat(np.arange(len(n)), n)
            least = np.zeros(len(n))
            if wanted is None:
                _, which = np.unique(hosts, return_inverse=True)
                least = share * np.bincount(which, weights=weights)[which] - 1e-6
                ranked = np.sort(every)  # most windows stand on one page only, and one page is seldom enough
                real = B.found(every, np.unique(ranked[1:][ranked[1:] == ranked[:-1]])) | (weights >= least)[page]
                every, page = every[real], page[real]
            code, first, place = np.unique(every, return_index=True, return_inverse=True)
            total = np.bincount(place, weights=weights[page], minlength=len(code))
            real = total >= least[page[first]]
            code, total, host_of = code[real], total[real], hosts[page[first]][real]
            del codes[:until], owner[:until]
            return pa.RecordBatch.from_arrays([pa.array(host_of), pa.array(code), pa.array(total)], names=["host", "code", "weight"])

        for batch in batches:
            hosts, weights, texts = (batch.column(i).to_pylist() for i in range(3))
            for i, _, found in _windows(texts, hosts, long):
                found = np.unique(found)
                if wanted is not None:
                    found = found[B.found(found, wanted.value)]
                codes.append(found)
                owner.append((hosts[i], weights[i]))
                size += len(found)
                if size >= CHUNK and not at:
                    at, at_size = len(codes), size
                if size >= 2 * CHUNK:  # so the last chunk isn't a few pages, which would name all they have
                    yield flush(at)
                    size -= at_size
                    at, at_size = len(codes), size
        if codes:
            yield flush(len(codes))

    return pages.mapInArrow(run, "host long, code long, weight double")


def boilerplate(read: DataFrame, long: int, share: float) -> DataFrame:
    """__host, code: the windows that `share` of the different pages of a host have; read: __host, __stream, __text."""
    own = read.where("__host is not null and __text <> ''")
    hosts = cut(own.groupBy("__host").agg(F.count_distinct("__stream").alias("pages")).where(F.col("pages") >= LEAST))
    copies = cut(own.groupBy("__stream").agg(F.count("*").alias("n")).where("n > 1"))
    small = copies.count() <= BROADCAST
    pages = own.join(F.broadcast(copies) if small else copies, "__stream", "left").select("__host", (1.0 / F.coalesce("n", F.lit(1))).alias("weight"), "__text")
    named = cut(_counted(pages, long, share).join(hosts, F.col("host") == F.col("__host"), "left_semi").select("host", "code").distinct())
    n_named = named.count()
    if not n_named:
        return named.select(F.col("host").alias("__host"), "code")
    if n_named <= BROADCAST:
        wanted = read.sparkSession.sparkContext.broadcast(np.sort(named.select("code").toArrow().column("code").to_numpy()))
        counted = _counted(pages, long, share, wanted)
    else:
        counted = _counted(pages, long, 0.0).join(named, ["host", "code"], "left_semi")
    total = counted.groupBy("host", "code").agg(F.sum("weight").alias("weight"))
    enough = F.col("weight") >= F.greatest(F.lit(float(LEAST)), share * F.col("pages")) - 1e-6
    return total.join(hosts, F.col("host") == F.col("__host")).where(enough).select("__host", "code")


def without(text: str, hit: np.ndarray, n: int, long: int, article: bool = False) -> str:
    """The text without blocks that are mostly covered and without covered ends of the others; hit: windows that count.

    Pages that show one article in several ways repeat it as a host repeats its notices. So of an article only blocks of
    SHORT tokens or fewer go, and a page that would lose more than LARGEST of its tokens stays whole."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + long, -1)
    covered = np.cumsum(edge[:n]) > 0
    out, at, lost = [], 0, 0
    for block in text.split("\n"):
        tokens = block.split(" ")
        gone = covered[at : at + len(tokens)]
        at += len(tokens)
        if article and len(tokens) > SHORT:
            out.append(block)
            continue
        if gone.mean() >= MOSTLY:
            lost += len(tokens)
            continue
        own = np.flatnonzero(~gone)
        first, end = int(own[0]), int(own[-1]) + 1
        kept = tokens[first if first >= long else 0 : end if len(tokens) - end >= long else len(tokens)]
        lost += len(tokens) - len(kept)
        out.append(" ".join(kept))
    return text if lost > LARGEST * n else "\n".join(out)


def _met(read: DataFrame, found: DataFrame, long: int) -> DataFrame:
    """read with __hit, the places of a page's windows that are boilerplate of its host (null: none), for more codes than a
    worker holds: windows meet codes by host and code, and only their places come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, texts = (batch.column(i).to_pylist() for i in range(3))
            for i, _, own in _windows(texts, hosts, long):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rows[i])), pa.array(np.full(len(own), hosts[i])), pa.array(own), pa.array(np.arange(len(own), dtype=np.int32))], names=["__row", "__host", "code", "at"])

    shown = read.where("__host is not null and __text <> ''").select("__row", "__host", "__text")
    windows = shown.mapInArrow(run, "__row long, __host long, code long, at int")
    hits = windows.join(found, ["__host", "code"], "left_semi").groupBy("__row").agg(F.array_sort(F.collect_list("at")).alias("__hit"))
    return read.join(hits, "__row", "left")


def extract(df: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"), long: int = LONG, share: float = SHARE) -> DataFrame:
    """`keep`, text and n_chars for every row."""
    read = read_pages(df, html, url, keep).withColumns({"__stream": F.xxhash64("__host", "__text"), "__row": F.monotonically_increasing_id()})
    read = cut(read)
    found = cut(boilerplate(read, long, share))
    columns = [F.col(f"`{c}`") for c in keep]
    n_found = found.count()
    if not n_found:
        return read.select(*columns, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
    if n_found <= BROADCAST:
        codes = found.toArrow()
        order = np.argsort(codes.column("__host").to_numpy(), kind="stable")
        hosts, starts = np.unique(codes.column("__host").to_numpy()[order], return_index=True)
        held = dict(zip(hosts.tolist(), map(np.sort, np.split(codes.column("code").to_numpy()[order], starts[1:])), strict=True)) if len(hosts) else {}
        by_host = df.sparkSession.sparkContext.broadcast(held)
        told = read.select(*columns, "__host", F.lit(None).cast("array<int>").alias("__hit"), "__article", "__text")
    else:
        by_host = None
        told = _met(read, found, long).select(*columns, "__host", "__hit", "__article", "__text")
    schema = T.StructType([*told.schema.fields[:-4], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hits, article, texts = (batch.column(batch.num_columns - k) for k in (4, 3, 2, 1))
            hosts, article, texts = hosts.to_pylist(), article.to_pylist(), texts.to_pylist()
            known = by_host.value if by_host is not None else {}
            some = [k for k, (h, t) in enumerate(zip(hosts, texts, strict=True)) if h in known and t] if by_host is not None else np.flatnonzero(hits.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for i, n, own in _windows([texts[k] for k in some], [hosts[k] for k in some], long):
                k = some[i]
                hit = np.flatnonzero(B.found(own, known[hosts[k]])) if by_host is not None else hits[k].values.to_numpy()
                if len(hit):
                    texts[k] = without(texts[k], hit, n, long, article[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(texts, pa.string())], names=schema.fieldNames())

    return told.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
