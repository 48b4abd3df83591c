"""URL rules against SQL and a plain loop; page extraction on fixed pages."""

import random

import pytest

from checks.compare import difference, duck
from trainlake.llm import html, urls
from trainlake.llm.queries import QUERIES, SQL


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "b.example.org", "/e"), ("allow", "com", "/fr/"), ("block", "com", "/fr/x"), ("block", "x-y.com", "/")]


def test_urls_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.org", "a.b.Example.ORG", "org", "x-y.com", "fx-y.com", "b.example.org:80", "", "..org", "Ä.com", "localhost"]
    paths = ["", "/", "/es/", "/es", "/fr/x?y=/es/", "/fr/#/", "?a=/fr/", "#x", "/e/é", "//fr/"]
    given = [None, "", "no scheme", "://", "a://b://c/fr/"] + [rng.choice(["http://", "HTTPS://", "x://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(200)]
    pages = spark.createDataFrame([(k, u, "rule", 1) for k, u in enumerate(given)], "page_id long, url string, rule string, digest int")
    rules = urls.rules_table(spark, [*RULES, RULES[0], ("block", None, "/")])
    out = urls.judge_urls(pages, rules)
    assert out.columns == ["page_id", "url", "digest", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {k: brute(u, RULES) for k, u in enumerate(given)}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_urls_query(spark, sf):
    assert difference(QUERIES["op9_url_filter"](spark, sf), SQL["op9_url_filter"], duck(sf)) is None


STOPS = [frozenset("the of and to a in is".split())]
LONG = "the end of the road is in a valley and to the north of it a lake"


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body>
    <header><p>{LONG}</p></header><nav><ul><li><a href="/a">the one</a></li></ul></nav><!-- <p>no</p> --><div class="ad">{LONG}</div>
    <aside>{LONG}</aside><div id="cookie-notice">{LONG}</div>
    <article><header><h1>Title &amp; more&nbsp; here</h1></header><p><b>One</b>two &lt;3 &unknown; &amp<br>line<p>short<div><p>{LONG}</div>
    <ul class="related"><li><a href="x">y</a></ul><form><input value=">">send</form></article>
    <section class="comments"><article><p>{LONG}</p></article></section><footer>&copy; {LONG}</footer></body></html>"""
    assert html.main_text(page, STOPS) == f"Title & more here\nOnetwo <3 &unknown; & line\nshort\n{LONG}"


def test_blocks_without_containers():
    page = f"<div><a href=1>home</a> <a href=2>the news of</a></div><h2>Head</h2><div>{LONG}</div><div>tiny</div><div>{LONG} {LONG}</div><p>end</p><p>of page</p><div>q w e r t z u i o p a s d f g h</div>"
    assert html.main_text(page, STOPS) == f"Head\n{LONG}\ntiny\n{LONG} {LONG}\nend"


def test_odd_pages(spark):
    given = [None, "", "   ", "<p", "<article>unclosed <b>text", "<script>never closed <p>x", "<article><p>" + "word " * 50_000, "no markup"]
    pages = spark.createDataFrame([(k, None, h, "old") for k, h in enumerate(given)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_text(pages).collect()}
    assert [got[k][0] for k in (0, 1, 2, 3, 5, 7)] == [""] * 6
    assert got[4] == ("unclosed text", 13) and got[6][1] == 249_999
    assert html.extract_text(pages.limit(0)).count() == 0


def test_extraction_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in QUERIES["op10_html_extraction"](spark, sf).collect()}
    assert set(got) == {r["page_id"] for r in rows}
    for r in rows:
        article = r["html"].split("<article>")[1].split("</article>")[0]
        plain = " ".join(html.html.unescape(article.replace("<p>", " ").replace("</p>", " ").replace("<br>", " ").replace("</h1>", " ").replace("<h1>", "").replace("<b>", "")).split())
        assert " ".join(got[r["page_id"]].split()) == plain


PARAGRAPH = f"<p>{LONG}</p><p>{LONG} once more</p>"
GERMAN = "Der alte Mann ging langsam durch den Wald und dachte an die Zeit, in der er noch jung war und mit seinen Freunden am See spielte."
CHINESE = "\u8fd9\u662f\u4e00\u4e2a\u5173\u4e8e" * 25


@pytest.mark.parametrize("wrapper", [
    '<div class="content no-sidebar">{}</div>', '<main class="has-sidebar">{}</main>', '<article class="post comments-open">{}</article>',
    '<div class="no-comments"><article>{}</article></div>', '<form id="aspnetForm"><nav><a href=x>the menu of</a></nav>{}</form>',
    '<div class="layout-social with-share">{}</div>', '<div id="sidebar-wrapper-comments">{}</div>', '<div class="sidebar"><div class="widget">{}</div></div>',
])
def test_names_are_overruled(wrapper):
    page = "<body><header>the name</header>" + wrapper.format(PARAGRAPH) + "<footer>the end</footer></body>"
    assert html.main_text(page, STOPS) == f"{LONG}\n{LONG} once more"


def test_names_hold_where_there_is_other_text():
    comments = "".join(f'<div class="comment"><p>{LONG} said reader {k}</p></div>' for k in range(30))
    page = f"<div>{PARAGRAPH}</div><section id=comments>{comments}</section><div class=cookie-notice>{LONG}</div><aside>{LONG}</aside>"
    assert html.main_text(page, STOPS) == f"{LONG}\n{LONG} once more"


@pytest.mark.parametrize("text", [GERMAN, CHINESE])
def test_languages_that_no_list_covers(text):
    page = f"<div><a href=1>home</a></div><div>{text}</div><div><a href=2>{text}</a></div>"
    assert html.main_text(page, STOPS) == text


def test_stop_words_of_each_language(spark):
    english, german = "the cat of the house and the dog", "die Katze und der Hund und die Maus"
    pages = [(f"<html lang='en-GB'><p>{english}",)] * 50 + [(f'<html class=x lang="de"><p>{german}',)] * 2 + [("<p>no declaration",)]
    lists = html.stop_words(spark.createDataFrame(pages, "html string"), 2)
    assert lists == [frozenset(("declaration", "no")), frozenset(("die", "und")), frozenset(("and", "the"))]
    assert html.page_stops([german], lists) == frozenset(("die", "und"))
    assert html.page_stops(["nichts davon"], lists) is None


def test_unclosed_quotes_and_tags():
    assert html.main_text('<article><p title="x>text</p>', STOPS) == "text"
    assert html.main_text("<article><p title='x>text</p><p>more", STOPS) == "text\nmore"


def test_time_grows_with_the_page():
    import time

    def seconds(n):
        start = time.perf_counter()
        html.blocks("<div>" * n + "x" + "</ul>" * n)
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(32_000) < 40 * max(seconds(2_000), 0.01)


def test_given_pages_without_containers(spark, sf):
    """The density rules alone: every element and name that marks a part is taken out."""
    import re

    rows = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    lists = html.stop_words(spark.createDataFrame([(h,) for h in rows], "html string"))
    good = kept = bad = rest = 0
    for page in rows:
        marked = re.sub(r"(?s)<article>(.*?)</article>", lambda m: "<div>" + re.sub(r"(?<=[\s>])([^\s<>]+)(?=[\s<])", "\\1\ue000", m[1]) + "</div>", page)
        plain = re.sub(r"</?(?:nav|header|footer|aside|main|section)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", marked)
        plain = re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|\S+?(?=[\s>]))", "", plain)
        words = html.main_text(plain.replace("\ue000", ""), lists)
        blocks = {b.text().replace("\ue000", ""): "\ue000" in b.text() for b in html.blocks(plain)}
        chosen = set(words.split("\n"))
        for text, inside in blocks.items():
            n = len(text.split())
            if inside:
                good, kept = good + n, kept + n * (text in chosen)
            else:
                rest, bad = rest + n, bad + n * (text in chosen)
    assert kept >= 0.95 * good and bad <= 0.05 * rest, (kept / good, bad / rest)
