"""Operator 4 against brute force."""

import random

import pytest

pytest.importorskip("varispark.llm")

from varispark.llm import lines  # noqa: E402
from varispark.llm.common import read  # noqa: E402

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        s = s[:i] + ("" if kind == 0 else rng.choice("abcé ")) + s[i + (kind != 1) :]
    return s


def test_banded_distance_is_exact():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choices("abc", k=rng.randrange(14)))
        b = edited(rng, a, rng.randrange(5)) if rng.random() < 0.8 else "".join(rng.choices("abc", k=rng.randrange(14)))
        for k in (0, 1, 2, 3):
            assert lines.edit_within(a, b, k) == (distance(a, b) <= k), (a, b, k)
    long = "".join(rng.choices("abcdefgh ", k=900))
    for n in range(6):
        b = edited(rng, long, n)
        assert lines.edit_within(long, b, 2) == (distance(long, b) <= 2)


def brute(texts, k=2, least=20):
    """(links, removed line numbers of each text, in order of id)."""
    rows = [(i, j, y) for i, t in enumerate(texts) for j, y in enumerate((t or "").split("\n")) if y.strip(" \t\n\r\x0b\x0c")]
    distinct = sorted({y for *_, y in rows})
    root = {y: y for y in distinct}

    def find(y):
        while root[y] != y:
            y = root[y]
        return y

    links = set()
    long = [y for y in distinct if len(y) >= least]
    for a in range(len(long)):
        for b in range(a):
            if abs(len(long[a]) - len(long[b])) <= k and distance(long[a], long[b]) <= k:
                links.add((long[b], long[a]))
                root[find(long[a])] = find(long[b])
    seen, gone = set(), [set() for _ in texts]
    for i, j, y in rows:
        c = find(y)
        if c in seen:
            gone[i].add(j)
        seen.add(c)
    return links, gone


@pytest.mark.parametrize("k,limit", [(1, 16), (2, 2), (2, 16), (3, 4)])
def test_lines_match_brute_force(spark, k, limit, monkeypatch):
    monkeypatch.setattr(lines, "PAIR_LIMIT", limit)
    monkeypatch.setattr(lines, "BLOCK", 3)
    rng = random.Random(k)
    base = ["".join(rng.choices("abcdé fgh", k=rng.randrange(18, 60))) for _ in range(25)]
    pool = base + [edited(rng, x, rng.randrange(1, 5)) for x in base for _ in range(3)] + ["short", "shirt", "", "  ", "short"]
    texts = [None, "", "\n\n", base[0], base[0]] + ["\n".join(rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(30)]
    table = spark.createDataFrame([(i, t, "x", 3, "h") for i, t in enumerate(texts)], "doc_id long, text string, line_dups string, u long, h string").repartition(3)
    links, gone = brute(texts, k)
    assert lines.line_links(table, k).count() == len(links)
    got = {r["doc_id"]: r for r in lines.dedup_lines(table, k).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = t if not gone[i] else "\n".join(y for j, y in enumerate(t.split("\n")) if j not in gone[i])
        assert got[i]["text"] == want
        assert {x["line_no"] for x in got[i]["line_dups"] or [] if x["removed"]} == gone[i]
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    for i, t in enumerate(texts):
        for x in got[i]["line_dups"] or []:
            assert x["n_links"] == degree.get(t.split("\n")[x["line_no"]], 0)


def test_real_documents_and_query(spark):
    docs = read(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    _, gone = brute([texts[i] for i in ids])
    got = {r["doc_id"]: r for r in lines.op4_query(spark, SF).collect()}
    assert [got[i]["n_removed"] for i in ids] == [len(g) for g in gone] and sum(map(len, gone)) > 50


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lines.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(None, "one line that is long enough"), (None, "one line that is long enough"), (4, "one line that is long enougH\nx")], schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(twice).collect())
    assert got == [(0, "one line that is long enough")] * 2 + [(4, "x")]


def test_meeting_tasks_grow_with_lines(spark):
    """Entries that meet in a task stay few however few shuffle partitions the session has."""
    docs = spark.createDataFrame([(i, f"a line of some words number {i % 7} and one more word {i}") for i in range(30)], "doc_id long, text string")
    assert lines.meetings(12, 1000, 2) == 12
    assert lines.meetings(12, 12_000_000, 2) > 100
    few, many = lines.candidates(docs), lines.candidates(docs, n_lines=1_000_000)
    assert {(r.u, r.v) for r in many.collect()} == {(r.u, r.v) for r in few.collect()} != set()
