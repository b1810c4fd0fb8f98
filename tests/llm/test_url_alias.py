import pytest
from pyspark.sql import functions as F

from llm.queries import RULES
from llm.url_alias import decoded, host_and_path, judge, page_links
from tests.llm.helpers import CLASHING, table

SCHEMA = "page_id bigint, url string, html string"
RULE_SCHEMA = "host string, path string, verdict string"


def canonical(url):
    return f'<html><head><LINK href="{url}" rel="canonical"></head>'


ROWS = [
    (1, "http://WWW.Example.org/es/1?x#y", "<p>"),
    (2, "https://example.org/en/1", None),
    (3, "https://example.org/fr", ""),
    (4, "https://notexample.org/es/", ""),
    (5, "http://a.com/fr/1", canonical("http://b.com/de/2")),
    (6, "http://b.com/de/2", ""),
    (7, "http://c.net/x", canonical("http://b.com/de/2#top")),
    (8, "http://d.net/y", '<meta content="0; url=/z" http-equiv=Refresh>'),
    (9, "http://d.net/z", canonical("http://hidden.com/de/1")),
    (10, "http://e.net", ""),
    (11, None, canonical("http://b.com/de/2")),
    (12, "no scheme/de/", ""),
    (13, "http://f.net/", canonical("http://f.net/2")),
    (14, "http://f.net/2", canonical("http://ok.org/")),
    (15, "http://f.net/3", canonical("http://f.net/2") + canonical("http://bad.com/de/")),
    (16, "http://example.org?/es/", "x" * 200_000),
    (17, "http://é.ÉCOM.com/de/", ""),
    (10, "http://e.net", ""),
    (None, "http://b.com/de/2", ""),
    (20, "http://a.net/p?a=1&b=2", canonical("http://worse.com/de/")),
    (21, "http://q.net/1", canonical("http://a.net/p?a=1&amp;b=2")),
    (22, "http://q.net/2", canonical("HTTP://A.Net/p?a=1&#38;b&#x3D;2")),
    (23, "http://q.net/3", canonical("http://a.net/P?a=1&b=2")),
    (24, "http://Q.NET/2#top", ""),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def same(url):
    scheme, colon, rest = url.split("#")[0].partition("://")
    if not colon:
        return scheme
    end = min([rest.index(c) for c in "/?" if c in rest] or [len(rest)])
    return scheme.lower() + colon + rest[:end].translate({c: c + 32 for c in range(65, 91)}) + rest[end:]


def plain(rows, links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    strip = same
    for a, b in links:
        if a and b and strip(a) != strip(b):
            root[find(strip(a))] = find(strip(b))
    marks = {}
    for u in list(root):
        marks.setdefault(find(u), set()).add(plain_rule(u)[1])
    out = []
    for i, url, _ in rows:
        rule, verdict = plain_rule(url)
        if verdict is None and url and strip(url) in root:
            group = marks[find(strip(url))]
            verdict = "allow" if "allow" in group else "block" if "block" in group else "allow"
        out.append((i, *plain_parts(url), rule, verdict or "allow"))
    return sorted(out, key=repr)


LINKS = [
    ("http://a.com/fr/1", "http://b.com/de/2"), ("http://c.net/x", "http://b.com/de/2"), ("http://d.net/y", "http://d.net/z"),
    ("http://d.net/z", "http://hidden.com/de/1"), ("http://f.net/", "http://f.net/2"), ("http://f.net/2", "http://ok.org/"),
    ("http://f.net/3", "http://f.net/2"), ("http://f.net/3", "http://bad.com/de/"), ("http://a.net/p?a=1&b=2", "http://worse.com/de/"),
    ("http://q.net/1", "http://a.net/p?a=1&b=2"), ("http://q.net/2", "HTTP://A.Net/p?a=1&b=2"), ("http://q.net/3", "http://a.net/P?a=1&b=2"),
]


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows(spark, clashing):
    pages = table(spark, ROWS, SCHEMA)
    if clashing:
        pages = pages.selectExpr("*", *[f"'x' AS `{c}`" for c in [*CLASHING, "page_url", "src", "dst", "verdict"]])
    more = [("http://e.net#a", "http://x.example.org/es/9"), (None, "http://e.net"), ("http://e.net", None)]
    links = table(spark, more, "src string, dst string")
    got = judge(pages, table(spark, RULES, RULE_SCHEMA), links).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(ROWS, [*LINKS, *more])


def test_links_found_in_html(spark):
    got = page_links(table(spark, ROWS, SCHEMA)).where("src is not null").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a, b in [*LINKS[:1], ("http://c.net/x", "http://b.com/de/2#top"), *LINKS[2:]])


def test_references_are_decoded_once(spark):
    cases = {
        "a&amp;b": "a&b", "&amp;amp;": "&amp;", "&#233;&#xE9;&#128578;": "éé\U0001f642", "&lt;&gt;&quot;&apos;": "<>\"'", "&": "&", "&&amp;&": "&&&",
        "&#xD800;&#0;&#9999999;": "&#xD800;&#0;&#9999999;", "&nbsp;x": "&nbsp;x", "": "", "plain": "plain",
    }
    df = table(spark, [(c,) for c in cases], "v string")
    assert {r[0]: r[1] for r in df.select("v", decoded(F.col("v"))).collect()} == cases


def test_links_with_references_and_capitals_pass_the_block_on(spark):
    got = {r["page_id"]: r["verdict"] for r in judge(table(spark, ROWS, SCHEMA), table(spark, RULES, RULE_SCHEMA)).collect()}
    assert [got[k] for k in (20, 21, 22, 23, 24)] == ["block", "block", "block", "allow", "block"]


def test_parts(spark):
    df = table(spark, [(r[1],) for r in ROWS], "url string")
    host, path = host_and_path(F.col("url"))
    assert [tuple(r) for r in df.select(host, path).collect()] == [plain_parts(r[1]) for r in ROWS]


def test_no_pages_or_no_rules(spark):
    rules = table(spark, RULES, RULE_SCHEMA)
    assert judge(table(spark, [], SCHEMA), rules).count() == 0
    got = judge(table(spark, ROWS, SCHEMA), rules.limit(0))
    assert {r["verdict"] for r in got.collect()} == {"allow"} and got.count() == len(ROWS)
