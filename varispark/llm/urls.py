"""Block and allow rules over urls, with block decisions carried to aliases.

A rule names a host and the beginning of a path and holds for the host with all its subdomains; the longest rule that
fits a url decides. Urls that redirect to each other or name each other as canonical are one document under several
names: redirect and canonical-link edges join them into connected components, found on Spark, and a block that a rule
gives to one url holds for every url of its component that has no rule of its own. An allow rule is never overruled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, written

#: (verdict, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules that go as a literal into every row's expression; longer lists are given as a table.
MAX_LITERAL = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN = re.compile(r"<(?:!--|(link|meta|base|script|style|textarea|title|noscript)(?=[\s/>]))", re.IGNORECASE)
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)")
_REFRESH = re.compile(r"\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?(.*)", re.IGNORECASE | re.DOTALL)


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def node_of(url: Column) -> Column:
    """The identity of a url among aliases, 32 bytes: host, path (empty is /) and query, without scheme and fragment."""
    path = path_of(url)
    query = F.regexp_extract(_after(url), "^[^?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.unhex(F.sha2(F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query).cast("binary"), 256)))


def _fits(rule: Column, host: Column, path: Column) -> Column:
    at = rule["host"]
    return ((at == "") | (host == at) | host.endswith(F.concat(F.lit("."), at))) & path.startswith(rule["path"])


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (host, path, …) with `rule`, the text of the longest rule that fits, else null, and its `action`.

    The length of a rule is that of host and path together; of two as long, the longer host decides, then block before
    allow. rules are a short list, or a table (action, host, path) of any length: that meets the distinct hosts by
    their suffixes, so only the rules that a host can use are tried on its urls. A rule with an empty host fits every
    host; nulls in a rule make it fit none.
    """
    order = lambda r: -F.length(r["host"]) - F.length(r["path"])
    if isinstance(rules, DataFrame):
        tail = F.explode(F.expr("concat(array(''), transform(sequence(1, size(split(host, '[.]'))), k -> substring_index(host, '.', -k)))"))
        own = rules.select(F.col("action").alias("__action"), F.translate("host", UPPER, LOWER).alias("__suffix"), F.col("path").alias("__path")).dropna()
        tails = urls.select("host").distinct().select("host", tail.alias("__tail")).distinct()
        parts = [c.alias(n) for c, n in ((F.col("__suffix"), "host"), (F.col("__path"), "path"), (F.col("__action"), "action"))]
        rule = F.struct(*parts)
        key = F.struct(order(rule).alias("o"), (-F.length("__suffix")).alias("h"), (F.col("__action") != "block").alias("b"), rule.alias("r"))
        lists = tails.join(own, F.col("__tail") == F.col("__suffix")).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["r"]).alias("__rules"))
        out = urls.join(lists, "host", "left")
    else:
        if len(rules) > MAX_LITERAL:
            raise ValueError(f"give more than {MAX_LITERAL} rules as a table")
        ranked = sorted({(a, h.lower(), p) for a, h, p in rules}, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block", r))
        rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for a, h, p in ranked]
        out = urls.withColumn("__rules", F.array(*rows) if rows else F.expr("cast(array() as array<struct<host: string, path: string, action: string>>)"))
    out = out.withColumn("__rule", F.get(F.filter("__rules", lambda r: _fits(r, F.col("host"), F.col("path"))), F.lit(0)))
    return out.select(*urls.columns, F.concat("__rule.host", "__rule.path").alias("rule"), F.col("__rule.action").alias("action"))


def page_links(url: str, html: str) -> list[str]:
    """The urls that a page names as its canonical address or redirects to; nothing in comments, scripts and the like."""
    found, base, at = [], url, 0
    while m := _OPEN.search(html, at):
        at, tag = m.end(), (m[1] or "").lower()
        if not tag:
            stop = html.find("-->", at)
            if stop < 0:
                break
            at = stop + 3
            continue
        at = _QUOTED.match(html, at).end()
        if tag not in ("link", "meta", "base"):
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            if not stop:
                break
            at = stop.end()
            continue
        has = {}
        for k, v in _ATTRIBUTE.findall(html, m.end(), at):
            has.setdefault(k.lower(), entities.unescape(v[1:-1] if v[0] in "\"'" else v).strip())
        to = None
        if tag == "base":
            base = _joined(url, has.get("href")) or base
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split():
            to = has.get("href")
        elif tag == "meta" and has.get("http-equiv", "").lower() == "refresh" and (told := _REFRESH.match(has.get("content", ""))):
            to = told[1].strip().strip("\"'").strip()
        if to and (to := _joined(base, to)):
            found.append(to)
    return found


def _joined(base: str, to: str | None) -> str | None:
    try:
        return urljoin(base, to) if to else None
    except ValueError:  # a broken host in brackets
        return None


def alias_edges(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of redirects (meta refresh) and canonical links; pages without any word of such a link aren't
    given to Python. Null url or html: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a page at a time: texts of a batch aren't copied together
                url = b.column(0)[i].as_py()
                if to := page_links(url, b.column(1)[i].as_py()):
                    yield pa.record_batch({"from_url": pa.array([url] * len(to)), "to_url": pa.array(to)})

    low = F.lower("html")
    held = pages.where(F.col("url").isNotNull() & (low.contains("canonical") | low.contains("refresh")))
    return held.select("url", "html").mapInArrow(run, "from_url string, to_url string")


def blocked_aliases(edges: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(node, alias_rule): every url of a component in which a rule blocks one, with the least such rule's text."""
    edges = written(edges, "url-edges")
    ends = edges.select(F.col("from_url").alias("url")).union(edges.select("to_url"))
    ends = ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("end"))
    bad = with_rule(ends, rules).where("action = 'block' and end is not null").groupBy("end").agg(F.min("rule").alias("rule"))
    ids = edges.select(node_of(F.col("from_url")).alias("u"), node_of(F.col("to_url")).alias("v")).dropna()
    found = written(components(ids), "url-components")
    worst = found.join(bad, F.col("node") == F.col("end")).groupBy("component").agg(F.min("rule").alias("alias_rule"))
    return found.join(worst, "component").select("node", "alias_rule")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and alias_rule, the rule by which an alias is blocked.

    The verdict is the rule's; without a rule it is block if a rule blocks an alias, else allow. Aliases come from the
    pages' own redirects and canonical links and from `redirects` (from_url, to_url), such as those a crawler logged.
    Null and empty urls have empty host and path, fit no rule and are allowed; null html has no links. Repeated pages
    and ids give repeated rows, an empty table none; other columns are ignored. A page of any length is read in
    one pass. A url that a third of all pages share is a plain join key, which Spark may split.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")).dropna())
    url = F.col("url")
    rows = with_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("own")), rules)
    out = rows.join(blocked_aliases(edges, rules), F.col("own") == F.col("node"), "left")
    verdict = F.coalesce("action", F.when(F.col("alias_rule").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_rule")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages")).drop("alias_rule")


#: Canonical links and redirects are read here in their plain form only: absolute, quoted, in the usual order.
OP11_SQL = r"""
WITH RECURSIVE said AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM said
), links AS (
  SELECT url AS a, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1) || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]*; *url=([^"]*)"', 1)) AS b
  FROM pages WHERE html IS NOT NULL AND url IS NOT NULL
), rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
names AS (SELECT a AS u FROM links UNION SELECT b FROM links),
plain AS (SELECT u, substr(u, strpos(u, '://') + 3) AS rest FROM names WHERE strpos(u, '://') > 0),
nodes AS (SELECT u, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^#]*') AS node FROM plain),
bad AS (SELECT node FROM (SELECT n.*, (SELECT arg_max(action, length(rhost) + length(rpath)) FROM rules WHERE (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath)) AS action FROM nodes n) WHERE action = 'block'),
edges AS (SELECT x.node AS a, y.node AS b FROM links JOIN nodes x ON x.u = links.a JOIN nodes y ON y.u = links.b),
reached(node) AS (
  SELECT node FROM bad UNION SELECT CASE WHEN e.a = r.node THEN e.b ELSE e.a END FROM reached r JOIN edges e ON e.a = r.node OR e.b = r.node
), ruled AS (
  SELECT p.*, (SELECT arg_max(rhost || rpath, length(rhost) + length(rpath)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS rule,
    (SELECT arg_max(action, length(rhost) + length(rpath)) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS action FROM parts p
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM nodes n JOIN reached r ON r.node = n.node WHERE n.u = ruled.url) THEN 'block' END, 'allow') AS verdict FROM ruled
"""
