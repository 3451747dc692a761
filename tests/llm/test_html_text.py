import html
import random
import re
import time

import numpy as np
from metrolith.llm import html_text as H
from pyspark.sql import functions as F


def text(page):
    return "\n".join(H.blocks(page)[0] or H.blocks(page)[1])


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">ok?</div>
    <article><h1>A &amp; B</h1><p><b>One<br><p>Two
    lines &lt;x&gt; &#233; &nbsp;end</p><aside>side</aside><form>f</form><div class="comments"><p>me too</p></div><ul><li>i</li><li>ii</li></ul><p>adds address</p></article>
    <section id="comments"><article><p>first!</p></article></section><footer>&copy; x</footer></body></html>"""
    assert text(page) == "A & B\nOne\nTwo lines <x> é end\ni\nii\nadds address"


def test_broken_markup():
    assert text("<article><p>a < b &am &amp<p>c</p") == "a < b &am &\nc"
    assert text("<div class='ad'>never closed<article><p>kept</article>") == "kept"
    assert text("<article>x<script>if (a</b) '</p>'</script>y</article><p>z") == "xy"
    assert text("<article>a</div></p></nav>b</article>c") in ("ab", "a\nb")
    assert text("<ARTICLE><P>U</P></ARTICLE>") == "U"
    assert text("<main><p>m</p></main>") == "m"
    assert text("plain words") == "plain words"
    assert text("<article><p>&lt;p&gt;</article><!-- open") == "<p>"
    for page in ("", "<", "<a", "</", "<!--", "<article", "&", "<script>", "<p " * 5000, "<<<<>>>>", "\x00<p>\x00"):
        H.blocks(page)


def test_words_in_attributes_never_empty_a_page():
    assert text('<div class="page no-sidebar"><p>the whole article text</p></div>') == "the whole article text"
    assert text('<body><div id="comments"><p>all there is</p></div><script>x</script></body>') == "all there is"
    assert text('<div class="sidebar">side</div><p>own</p>') == "own" and text("<nav>menu</nav><p hidden>no</p>") == ""
    long = "<article>" + "".join(f"<p>{'word ' * 50}{i}</p>" for i in range(20_000)) + "</article>"
    assert text(long).count("\n") == 19_999


def test_driver_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r.page_id: r for r in H.extract(pages).collect()}
    assert len(out) == pages.count()
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|ul|li)>", body)]
        assert out[p.page_id].text == "\n".join(x for x in lines if x) and out[p.page_id].n_chars == len(out[p.page_id].text)


def test_repeated_runs_of_a_host_go(spark):
    draw = random.Random(1)
    own = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    menu = "home news sport weather travel shop about"
    bodies = [own(30) for _ in range(12)]
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<div>{menu}</div><div>{b} read more of this from our great team</div>") for i, b in enumerate(bodies)]
    rows += [(50, "http://other.org/", f"<div>{menu}</div>"), (51, None, f"<div>{menu}</div>"), (52, None, f"<div>{menu}</div>"), (53, "http://h0.org/x", None), (54, "http://h0.org/y", "")]
    rows += [(60, "http://twin.org/1", "<p>one two three four five six seven</p>"), (61, "http://twin.org/2", "<p>one two three four five six seven</p>")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "open": F.lit(1), "text": F.lit(2)})
    out = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert all(out[i] == b for i, b in enumerate(bodies))
    assert out[50] == out[51] == out[52] == menu and out[53] == out[54] == "" and out[60] == out[61] != ""
    assert H.extract(pages.where("false")).count() == 0


def test_boilerplate_inside_articles_goes_by_host(spark):
    draw = random.Random(2)
    own = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    promo = "follow us for more stories like this every day"
    bodies = [own(40) for _ in range(20)]
    rows = [(i, "http://h.org/%d" % i, f"<article><p>{b}</p><div>{promo}</div></article>") for i, b in enumerate(bodies)]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == b for i, b in enumerate(bodies))


def test_text_that_few_pages_share_stays(spark):
    draw = random.Random(3)
    own = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    phrase, article = "as far as anybody here can tell", own(50)
    rows = [(i, f"http://h.org/{i}", f"<div>{own(9)} {phrase if i < 5 else own(7)} {own(9)}</div>") for i in range(20)]
    rows += [(30 + i, f"http://h.org/{30 + i}", f"<div>{article}</div><div>{own(12)}</div>") for i in range(2)]
    rows += [(40 + i, f"http://mid.org/{i}", f"<div>{own(9)} {phrase} {own(9)}</div>") for i in range(6)]
    rows += [(50 + i, "http://copy.org/", f"<p>{article}</p>") for i in range(5)] + [(60, "http://copy.org/x", f"<p>{own(20)}</p>")]
    out = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == text(page) for i, _, page in rows)


def test_words_in_attributes_leave_paragraphs_and_wrappers_of_an_article():
    page = '<article><p>First words.</p><p class="share">Important body line</p><div class="page no-sidebar"><p>in wrapper</p></div><div class="share-buttons">tweet</div><ol><li class="comment">me too</li></ol></article>'
    assert text(page) == "First words.\nImportant body line\nin wrapper"
    assert text('<article><div class="content share"><p>the whole long article</p></div><p>end</p></article>') == "the whole long article\nend"
    assert text('<article><p>short</p><section class="comments"><p>a much longer comment than the article is itself</p></section></article>') == "short"


def test_an_article_that_a_host_shows_in_several_ways_stays(spark):
    draw = random.Random(6)
    own = lambda n: " ".join(f"u{draw.randrange(10**6)}" for _ in range(n))
    article, promo = own(200), "follow us for more stories like this every day"
    rows = [(i, f"http://four.org/?p={i}", f"<article><p>{article}</p><p>{own(6)}</p></article>") for i in range(4)]
    rows += [(10 + i, f"http://mixed.org/{i}", f"<article><p>{article if i < 6 else own(200)}</p><p>{own(9)}</p><div>{promo}</div></article>") for i in range(10)]
    rows += [(30 + i, f"http://plain.org/{i}", f"<div>{article}</div><div>{own(9)}</div>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in H.extract(pages).collect()}
    for i, _, page in rows:
        assert out[i] == text(page).removesuffix("\n" + promo), i
    few = H.BROADCAST
    try:
        H.BROADCAST = 0  # codes meet windows by shuffle
        assert {r.page_id: r.text for r in H.extract(pages).collect()} == out
    finally:
        H.BROADCAST = few


def plain_boilerplate(pages, long, share, least):
    """pages: host, text. The runs of `long` tokens, by host, that enough of its different pages have."""
    out = {}
    for host in {h for h, _ in pages}:
        texts = {t for h, t in pages if h == host and t}
        seen = {}
        for t in texts:
            tokens = t.split()
            for run in {tuple(tokens[i : i + long]) for i in range(len(tokens) - long + 1)}:
                seen[run] = seen.get(run, 0) + 1
        out[host] = sum(n >= max(least, share * len(texts)) for n in seen.values()) if len(texts) >= least else 0
    return {h: n for h, n in out.items() if n}


def test_shared_runs_match_brute_force(spark):
    draw = random.Random(12)
    pages = [(draw.choice("abcd"), "\n".join(" ".join(draw.choice("xyz") for _ in range(draw.randrange(1, 12))) for _ in range(draw.randrange(4)))) for _ in range(120)]
    pages += [("e", "one two three four five six seven")] * 4 + [("f", "one two three four five six")] * 2 + pages[:9]
    rows = [(i, ord(h), t) for i, (h, t) in enumerate(pages)]
    read = spark.createDataFrame(rows, "i long, __host long, __text string").withColumn("__stream", F.xxhash64("__host", "__text"))
    for long, share in ((3, 0.5), (6, 0.5), (4, 0.2)):
        found = H.boilerplate(read, long, share).groupBy("__host").count().collect()
        assert {chr(r["__host"]): r["count"] for r in found} == plain_boilerplate(pages, long, share, H.LEAST)


def test_a_page_is_read_twice_only_if_words_in_attributes_can_change_its_article(spark, monkeypatch):
    read, seen = H._blocks, []
    monkeypatch.setattr(H, "_blocks", lambda page, words: seen.append(words) or read(page, words))
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where("html is not null").collect():
        seen.clear()
        H.blocks(r.html)
        assert seen == ["all"]
    draw = random.Random(9)
    tags = ["<article>", "</article>", "<main>", "<div>", '<div class="ad">', '<p class="share">', '<li class="reply">', '<article class="promo">', '<div class="comments">', '<body class="search">', "<div hidden class=ad>", "</div>", "</p>", "</body>", "<nav>", "</nav>", "<span class=ad>", "</span>"]
    for _ in range(3000):
        page = "".join(draw.choice(tags) + draw.choice(["", f"w{draw.randrange(50)} "]) for _ in range(draw.randrange(1, 14)))
        main, rest, _ = read(page, "all")
        if main or not rest:
            other, rest_too, _ = read(page, "comment")
            if sum(map(len, other)) > 2 * sum(map(len, main)):
                main, rest = other, rest_too
        if not main and not rest:
            main, rest, _ = read(page, "none")
        assert H.blocks(page)[0] == main and text(page) == "\n".join(main or rest), page


def test_pages_without_repeats_are_not_counted_again(spark, monkeypatch):
    counted, seen = H._counted, []
    monkeypatch.setattr(H, "_counted", lambda *a: seen.append(a) or counted(*a))
    rows = [(i, "http://h.org/", f"<p>{' '.join(f'w{i}x{j}' for j in range(20))}</p>") for i in range(80)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: page[3:-4] for i, _, page in rows} and len(seen) == 1


def test_pages_meet_many_named_windows_in_seconds(spark):
    pages = spark.range(4000).selectExpr("id % 7 as __host", "1d as weight", "concat('a b c d e f g w', id, ' x', id) as __text")
    every = H._counted(pages, 3, 0.0).groupBy("host", "code").sum("weight").collect()
    codes = np.array([r["code"] for r in every if r["code"] % 3], dtype=np.int64)
    many = np.sort(np.append(codes, np.arange(900_000, dtype=np.int64)))
    began = time.time()
    some = H._counted(pages, 3, 0.0, spark.sparkContext.broadcast(many)).groupBy("host", "code").sum("weight").collect()
    assert time.time() - began < 15 and len(codes) > 4000
    assert sorted(some) == sorted(r for r in every if r["code"] % 3)
