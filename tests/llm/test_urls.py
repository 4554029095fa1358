"""Operator 11 against brute force and odd rows."""

import re
from urllib.parse import urljoin

import pytest

pytest.importorskip("varispark.llm")

from varispark.llm import urls as U  # noqa: E402

SCHEMA = "page_id long, url string, html string, rule string, node string, host int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), len(h), a == "block", a, h + p) for a, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, None)


def identity(url):
    rest = url.split("://", 1)[1]
    host, path = parts(url)
    query = re.match(r"[^?#]*([^#]*)", rest)[1]
    return host, path or "/", query


def brute(rows, edges, rules):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if "://" in a and "://" in b:
            root[find(identity(a))] = find(identity(b))
    bad = {find(identity(u)) for e in edges for u in e if "://" in u and ruled(u, rules)[0] == "block" and identity(u) in root}
    out = []
    for page_id, url, _ in rows:
        action, rule = ruled(url, rules)
        alias = url is not None and "://" in url and find(identity(url)) in bad
        out.append((page_id, *parts(url), rule, action or ("block" if alias else "allow")))
    return sorted(out, key=str)


def canonical(to):
    return f'<html><head><link rel="canonical" href="{to}"></head><body>x</body></html>'


ROWS = [
    (1, "http://A.Example.NET/en/1?q=1#x", "<p>"),
    (2, "https://b.example.net/de/1", None),
    (3, "https://alias.com/x", canonical("https://b.example.net/de/1")),
    (4, "https://second.com/?a=1#frag", canonical("//alias.com/x")),
    (5, "https://good.example.net/en/5", canonical("https://b.example.net/de/1")),
    (6, "http://www.example.com/de/9", "<meta http-equiv=refresh content=\"0; URL='http://target.org/de/1'\">"),
    (7, "http://target.org/de/1", ""),
    (8, "http://target.org/fr/1", canonical("http://target.org/de/1")),
    (9, "http://free.com/1", "<!-- " + canonical("http://b.example.net/de/1") + " --><script>'" + canonical("http://b.example.net/de/1") + "'</script>"),
    (10, None, canonical("http://b.example.net/de/1")),
    (11, "", None),
    (12, "no scheme", canonical("http://b.example.net/de/1")),
    (13, "http://net", None),
    (14, "http://notnet/", None),
    (15, "http://example.net/e", None),
    (None, "http://fake.net/en/", None),
    (3, "https://alias.com/x", None),
    (16, "x://broken.com/", canonical("http://[bad/")),
    (17, "http://a://b.net/x", "<link rel=canonical"),
    (18, "https://alias.com/x#part", "<base href='http://alias.com/y/'><link href='z' rel='nofollow CANONICAL'>"),
    (19, "https://alias.com/y/z", "canonical"),
]
EDGES = [(u, urljoin(u, t)) for u, t in [(ROWS[2][1], ROWS[1][1]), (ROWS[3][1], "https://alias.com/x"), (ROWS[4][1], ROWS[1][1]), (ROWS[5][1], ROWS[6][1]), (ROWS[7][1], ROWS[6][1]), (ROWS[17][1], "http://x")][:5]] + [("https://alias.com/x", "http://alias.com/y/z"), ("no scheme", "http://b.example.net/de/1")]


@pytest.mark.parametrize("as_table", [False, True])
def test_verdicts_match_brute_force(spark, as_table):
    rules = spark.createDataFrame(U.RULES, "action string, host string, path string") if as_table else U.RULES
    got = U.judged(table(spark, ROWS), rules).collect()
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == brute(ROWS, EDGES, U.RULES)
    by = {r["page_id"]: r for r in got if r["page_id"] not in (3,)}
    assert by[4]["verdict"] == "block" and by[4]["alias_rule"] == "net/"
    assert by[5]["verdict"] == "allow" and by[5]["rule"] == "example.net/en/"
    assert by[7]["verdict"] == "block" and by[8]["verdict"] == "allow" and by[9]["verdict"] == "allow"


def test_longest_rule_wins_and_ties_are_defined(spark):
    rules = [("block", "", "/"), ("allow", "b.com", "/"), ("block", "a.b.com", "/"), ("allow", "b.com", "/xy"), ("allow", "b.com", "/s"), ("block", "b.com", "/s"), ("block", None or "c.com", "")]
    rows = [(i, u, None) for i, u in enumerate(["http://b.com/", "http://a.b.com/", "http://a.b.com/xyz", "http://q.com/", "http://q.com", "http://b.com/s", "http://c.com"])]
    want = brute(rows, [], rules)
    for given in (rules, spark.createDataFrame(rules, "action string, host string, path string")):
        got = U.judged(table(spark, rows), given).collect()
        assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got), key=str) == want


def test_redirect_table_chains_and_empty_tables(spark):
    n = 60
    rows = [(i, f"http://h{i}.com/", None) for i in range(n)] + [(n, "http://h.net/", None)]
    hops = spark.createDataFrame([(f"https://h{i}.com", f"http://h{i + 1}.com/") for i in range(n - 20)] + [("http://h0.com/", "http://h.net/"), (None, "http://h50.com/")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in U.judged(table(spark, rows), U.RULES, hops).collect()}
    assert got == {i: "block" if i <= n - 20 or i == n else "allow" for i in range(n + 1)}
    assert U.judged(table(spark, [])).count() == 0
    assert U.judged(table(spark, rows), []).where("verdict = 'block'").count() == 0


def test_long_pages_are_read_in_one_pass():
    for piece in ("<link rel='canonical", "<!--", "<script>", '<meta content="', "<link ", "<base href=x>"):
        U.page_links("http://a.com/", piece * 60_000)
    assert U.page_links("http://a.com/", "<p>" * 200_000 + canonical("/b")) == ["http://a.com/b"]


def test_registered_query_reads_all_pages(spark):
    got = U.op11_query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
