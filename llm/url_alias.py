"""URL filters that follow redirects and canonical links, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved
from llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Both empty
    for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def node(url: Column) -> Column:
    """What a link points to: the URL without its fragment, A-Z lower-cased in scheme and host, which ignore case."""
    whole = F.regexp_extract(url, r"^([^#]*)", 1)
    site = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.translate(site, _UPPER, _LOWER), F.substr(whole, F.length(site) + 1))


def decoded(value: Column) -> Column:
    """An attribute's value with numeric character references and those of & < > " ' decoded, once. Others, and numbers that are no character,
    stay as they are."""
    pieces = F.regexp_extract_all(value, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);|&|[^&]+"), F.lit(0))

    def plain(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
        hexits = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+);$", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexits != "", F.conv(hexits, 16, 10).cast("long"))
        real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
        out = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, character in named.items():
            out = out.when(piece == name, character)
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, plain), "")


def resolved(base: Column, link: Column) -> Column:
    """A link's absolute URL: as it is with ``://``, else completed from the page's URL by scheme, host, query or folder. Dot segments stay."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    site = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*((?:[^?#]*/)?)", 1)
    here = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(here, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Canonical links and refresh redirects in the whole html, as ``src`` and ``dst``; references such as ``&amp;`` are decoded."""
    tags = F.regexp_extract_all(ref(html_col).cast("string"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    rows = pages.select(ref(url_col).cast("string").alias("src"), F.explode(tags).alias("tag"))
    quoted = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(name: str) -> Column:
        pattern = rf"(?is)\s{name}\s*=\s*{quoted}"
        return F.concat(*[F.coalesce(F.regexp_extract("tag", pattern, k), F.lit("")) for k in (1, 2, 3)])

    canonical = F.when(F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)"), attribute("href"))
    refresh = F.when(F.lower(attribute("http-equiv")) == "refresh", F.regexp_extract(attribute("content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1))
    link = F.trim(F.coalesce(canonical, refresh)).alias("link")
    rows = rows.select("src", link).where((F.col("link") != "") & F.col("src").isNotNull())
    return rows.select("src", resolved(F.col("src"), decoded(F.col("link"))).alias("dst"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``own`` (the rule's verdict) to distinct URLs in ``urls.url``. A rule (``host``, ``path``, ``verdict``) fits its host, all
    subdomains, and paths that start with its own; the longest host and path wins, then allow before block."""
    host, path = host_and_path(F.col("url"))
    parts = urls.select("url", host.alias("host"), path.alias("path"))
    sites = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = sites.select("host", "path", F.explode(suffixes).alias("suffix"))
    known = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    fits = asked.join(known, (F.col("suffix") == F.col("r_host")) & F.startswith(F.col("path"), F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("n"), (F.col("r_verdict") == "allow").alias("allow"), rule.alias("rule"), F.col("r_verdict").alias("own"))).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.own").alias("own"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """A row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (the longest that fits, as host and path, else null), ``verdict`` (allow or
    block) and ``alias_root`` (the smallest URL of its aliases, null without any).

    A page with a rule has the rule's verdict. Pages without one take it from their aliases: the URLs that redirects and
    canonical links connect them with, in any direction and over any number of steps, targets outside the table included. If
    a rule allows one of the aliases, the page is allowed; else, if a rule blocks one, it is blocked; else allowed. Links come from
    the html (canonical links, refresh redirects, character references decoded) and from ``links`` (``src``, ``dst``), such as redirects seen by
    a crawler. URLs that differ only in the fragment, or in the case of scheme and host, are the same; ``alias_root`` is
    without fragment and in small letters there.

    Each distinct URL is judged once, from (host, path) groups, so a hot host or URL is no larger than another. Null URLs and
    those without ``://`` have an empty host and path and no rule; null html has no links; null ends are no links. Repeated rows
    stay repeated, empty tables give an empty result, other columns are not looked at.
    """
    own = pages.select(ref(id_col).alias("id"), ref(url_col).cast("string").alias("page_url"))
    found = page_links(pages, url_col, html_col)
    if links is not None:
        found = found.unionAll(links.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    edges = saved(found.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")).where("a != b").distinct())
    groups = saved(components(edges))
    urls = own.select(F.col("page_url").alias("url")).where("url is not null").distinct()
    decided = ruled(urls, rules)
    # The rules on all members of a group, targets that are no pages of the table included.
    members = ruled(groups.select(F.col("node").alias("url")), rules).join(groups.withColumnRenamed("node", "g_url"), F.col("url") == F.col("g_url"))
    rank = F.when(F.col("own") == "allow", 2).when(F.col("own") == "block", 1).otherwise(0)
    verdicts = members.groupBy("root").agg(F.max(rank).alias("rank"))
    aliases = groups.join(verdicts, "root").select(F.col("node").alias("n"), F.col("root").alias("alias_root"), "rank")
    decided = decided.join(aliases, node(F.col("url")) == F.col("n"), "left")
    from_alias = F.when(F.col("rank") == 1, F.lit("block")).otherwise(F.lit("allow"))
    decided = decided.select("url", "host", "path", "rule", F.coalesce("own", from_alias).alias("verdict"), "alias_root")
    joined = own.join(decided, F.col("page_url") == F.col("url"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        "alias_root",
    )
