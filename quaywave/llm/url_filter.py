"""URL filtering with redirect equivalence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import let
from .common import materialize, spread_join
from .components import connected_components

#: (verdict, host and path) of the default list.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains, if the path starts with its path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _relative(link: Column, url: Column) -> Column:
    """Path and query of a link against the page's path: . and .. steps taken, a query alone keeps the path."""
    base, query = path_of(url), F.regexp_extract(link, r"(?s)^[^?]*(\?.*)$", 1)
    steps = F.concat(F.regexp_extract(base, r"(?s)^/(.*/)[^/]*$", 1), F.regexp_extract(link, r"(?s)^([^?]*)", 1))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    def walk(parts: Column) -> Column:
        taken = F.aggregate(parts, F.array().cast("array<string>"), step)
        ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(taken, ends), "/"))

    return F.concat(F.when(F.startswith(link, F.lit("?")), base).otherwise(let(F.split(steps, "/", -1), walk)), query)


def resolve(link: Column, url: Column) -> Column:
    """A link of a page as a node; null for none and for those of other schemes (mailto:). Fragments aren't part of a node.

    Every part is bound once by let: put into each other as plain columns they would multiply in the plan."""

    def against(x: Column) -> Column:
        link, url = x["link"], x["url"]
        scheme, root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        whole = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(root, link))
        return whole.when((link != "") & (root != "") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(root, _relative(link, url)))

    link = F.trim(F.regexp_replace(F.regexp_replace(link, "(?i)&amp;", "&"), "#.*$", ""))
    return let(let(F.struct(link.alias("link"), url.alias("url")), against), node_of)


def node_of(url: Column) -> Column:
    """Scheme and host lower-cased, no fragment, an empty path as /."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    head = F.translate(F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return let(F.struct(head.alias("head"), rest.alias("rest")), lambda x: F.when(F.length(x["head"]) > 0, F.concat(x["head"], F.when(F.startswith(x["rest"], F.lit("/")), x["rest"]).otherwise(F.concat(F.lit("/"), x["rest"])))))


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """u, v: a page's node and where its canonical links and refresh redirects lead, against its base address where it names one."""
    html, url = F.col(html_col), F.col(url_col)
    tag = lambda name: F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^<>]*>"), F.lit(0))
    canonical = F.filter(tag("link"), lambda t: t.rlike(r"""(?i)\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""))
    canonical = F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]*)""", 1))
    refresh = F.filter(tag("meta"), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    refresh = F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'>]*)""", 1))
    base = F.regexp_extract(html, r"""(?i)<base\b[^<>]*\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    rows = pages.where(html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), base.alias("base"), F.concat(canonical, refresh).alias("links")).where(F.size("links") > 0)
    against = let(F.coalesce(resolve(F.col("base"), F.col("url")), F.col("url")), lambda b: F.transform("links", lambda link: resolve(link, b)))
    return rows.select(node_of(F.col("url")).alias("u"), F.explode(against).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    A page under a rule has the rule's verdict. Others take that of their aliases: the connected component
    over canonical links, refresh redirects and `redirects` (from, to: optional, e.g. from a crawl's log),
    pages and link targets alike. There an alias under an allow rule comes before any under a block rule;
    without either the verdict is allow. A null url, or one without ://, has empty host and path and no aliases.
    Repeated pages are judged each; no links or an empty table are fine. Rules are configuration: they
    become one expression, so keep them to some thousands."""
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("from")).alias("u"), node_of(F.col("to")).alias("v")))
    links = materialize(links, "url-links")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "said": said})
    if links.isEmpty():
        return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"))
    aliases = connected_components(links).withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}).withColumn("said", said)
    told = aliases.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allow"), F.max(F.col("said") == "block").alias("block"))
    blocked = told.where(F.col("block") & ~F.coalesce("allow", F.lit(False))).select("component", F.lit("block").alias("alias"))
    # A giant component and a much repeated url are hot keys of these joins; pages without a node take no part.
    named = materialize(spread_join(aliases.select("node", "component"), blocked, ["component"], ["node"]).select("node", "alias"), "url-blocked")
    judged = materialize(judged.withColumn("node", node_of(F.col("url"))), "url-judged")
    out = spread_join(judged.where("node IS NOT NULL"), named, ["node"], ["id"], "left").unionByName(judged.where("node IS NULL"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "alias", F.lit("allow")).alias("verdict"))
