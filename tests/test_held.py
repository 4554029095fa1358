"""Sites held in state: streams of several batches against counts over all rows, and state that goes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varispark.streaming import held

LENGTHS = {"chr1": 3000, "chr2": 3000}
SCHEMA = "chrom string, start int, pos int, base string, last int"


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get(held.STORE[0])
    spark.conf.set(*held.STORE)
    yield
    spark.conf.set(held.STORE[0], before)


def run(spark, batches, schema, work, tmp_path):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = work(s)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), state


def brute(rows, near):
    seen = [r for r in rows if r[3] is not None]
    gone = [(c, p, e) for c, _, p, b, e in rows if b is None and e is not None]
    n, depth = Counter((c, p, b) for c, _, p, b, _ in seen), Counter((c, p) for c, _, p, *_ in seen)
    return sorted((c, p, b, k, depth[c, p], sum(1 for d, s, e in gone if d == c and s - near <= p <= e + near)) for (c, p, b), k in n.items())


def test_stream_with_long_deletions_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for chrom in LENGTHS:
        for _ in range(150):
            start = rng.randrange(1, 900)
            rows += [(chrom, start, start + i, rng.choice("ACGT"), None) for i in range(rng.randrange(1, 6))]
            if rng.random() < 0.3:
                first = start + rng.randrange(5)
                rows.append((chrom, start, first, None, first + rng.randrange(1, 200)))  # far beyond any read
    rows.sort(key=lambda r: r[:2])
    cut = len(rows) // 6
    batches = []
    for i in range(6):  # reads of one start stay in one batch
        part = rows[i * cut : (i + 1) * cut if i < 5 else None]
        while batches and part and part[0][:2] == batches[-1][-1][:2]:
            batches[-1].append(part.pop(0))
        batches.append(part)
    batches.append([("chr2", 2900, None, None, None)])
    got, state = run(spark, batches, SCHEMA, lambda s: held.pileup_behind_deletions(s, LENGTHS, 3, width=256), tmp_path)
    assert got == brute(rows, 3)
    assert max(state) > 0 and state[-1] == 0


def test_a_site_stays_open_while_a_deletion_reaches_over_it(spark, tmp_path):
    one = [("chr1", 10, 12, "A", None), ("chr1", 10, 11, None, 400)]
    batches = [one, [("chr1", 100, 100, "C", None)], [("chr1", 300, 300, "G", None)], [("chr1", 399, 401, "T", None)]]
    got, state = run(spark, batches, SCHEMA, lambda s: held.pileup_behind_deletions(s, LENGTHS), tmp_path / "a")
    assert got == []  # the frontier is at 399, the deletion ends at 400
    got, _ = run(spark, [*batches, [("chr1", 402, 402, "A", None)]], SCHEMA, lambda s: held.pileup_behind_deletions(s, LENGTHS), tmp_path / "b")
    assert got == [("chr1", 12, "A", 1, 1, 1), ("chr1", 100, "C", 1, 1, 1), ("chr1", 300, "G", 1, 1, 1), ("chr1", 401, "T", 1, 1, 0)]


def test_state_falls_after_a_flush(spark, tmp_path):
    batches = [[("chr1", i, i, "A", None) for i in range(a, a + 50)] for a in range(1, 300, 50)]
    batches += [[("chr1", 2000, 2000, "C", None)], [("chr1", 2500, None, None, None)]]
    got, state = run(spark, batches, SCHEMA, lambda s: held.pileup_behind_deletions(s, LENGTHS), tmp_path)
    assert len(got) == 301 and max(state) <= 120 and state[-1] == 0


def test_clips_count_all_at_their_site(spark, tmp_path):
    clips = [("chr1", s, site, f"r{i}") for i, (s, site) in enumerate([(10, 10), (10, 38), (30, 38), (60, 38 + 30), (38, 38), (38, 38)])]
    clips.sort()
    got, state = run(spark, [clips[:2], clips[2:], [("chr1", 250, 250, "late")], [("chr2", 5, 5, "next")]], "chrom string, start int, site int, qname string", lambda s: held.clips_behind_frontier(s, LENGTHS), tmp_path)
    n = Counter(c[2] for c in clips) + Counter([250])
    assert got == sorted([(c, site, q, 1, n[site]) for c, _, site, q in clips] + [("chr1", 250, "late", 1, 1)])


def test_duplicate_groups_flush_in_order_and_odd_rows(spark, tmp_path):
    rows = [("chr1", 5, "+"), ("chr1", 5, "+"), ("chr1", 5, "-"), ("chr9", 1, "+"), (None, 7, "+"), ("chr1", None, "+")]
    got, _ = run(spark, [rows, [("chr1", 6, "+")], [("chr2", 1, "+")]], "chrom string, pos int, strand string", lambda s: held.duplicate_groups(s, LENGTHS, F.col("strand")), tmp_path)
    assert got == [("chr1", 5, "+", 2), ("chr1", 5, "-", 1), ("chr1", 6, "+", 1)]
    got, _ = run(spark, [[("chr1", 5, "+")]], "chrom string, pos int, strand string", lambda s: held.duplicate_groups(s, LENGTHS, F.col("strand")), tmp_path / "one")
    assert got == []


def test_deletions_near_a_site_are_found_without_a_scan_of_all():
    """What is given out equals a scan of every deletion for every site, and a bin of many of both takes no such time."""
    import random
    import time
    from types import SimpleNamespace

    from varispark.streaming.held import Sites

    def run(sites, spans, frontier, margin, near):
        s = Sites(margin, near)
        state = SimpleNamespace(removeKey=lambda k: None, updateValue=lambda k, v: None)
        s.held, s.spans, s.handle = state, state, SimpleNamespace(listTimers=lambda: [], registerTimer=lambda t: None)
        own, open_ = dict(sites), dict(spans)
        frames = list(s._release(("chr1", 0), frontier, own, open_, (dict(sites), dict(spans))))
        return [tuple(r) for f in frames for r in f[["place", "what", "n", "total", "deletions"]].itertuples(index=False)], own, open_

    rng = random.Random(3)
    for _ in range(50):
        near, margin, frontier = rng.randint(0, 4), rng.randint(0, 5), rng.randint(20, 70)
        sites = {(rng.randint(1, 60), rng.choice("AC")): rng.randint(1, 3) for _ in range(25)}
        spans = {(a, a + rng.randint(0, 20)): rng.randint(1, 3) for a in (rng.randint(1, 60) for _ in range(12))}
        over = lambda p: {k: n for k, n in spans.items() if k[0] - near <= p <= k[1] + near}  # noqa: B023, E731
        final = {p for p, _ in sites if max([p + margin, *(b for _, b in over(p))]) < frontier}
        want = sorted((p, w, n, sum(m for (q, _), m in sites.items() if q == p), sum(over(p).values())) for (p, w), n in sites.items() if p in final)
        got, own, left = run(sites, spans, frontier, margin, near)
        assert sorted(got) == want and {p for p, _ in own} == {p for p, _ in sites} - final
        kept = {p for p, _ in sites} - final
        assert set(left) == {k for k in spans if k[1] + near + margin >= frontier or any(k[0] - near <= p <= k[1] + near for p in kept)}
    began = time.process_time()
    got, _, _ = run({(p, "A"): 1 for p in range(20000)}, {(p, p + 99): 1 for p in range(20000)}, 1 << 30, 5, 5)
    assert len(got) == 20000 and time.process_time() - began < 5


def test_state_is_stored_by_pages():
    """A bin's sites go to the store in a few rows, and only pages that changed do."""
    kept, calls = {}, []

    class State:
        def updateValue(self, k, v):  # noqa: N802
            calls.append(k)
            kept[k] = tuple(list(x) for x in v)

        def removeKey(self, k):  # noqa: N802
            calls.append(k)
            del kept[k]

        def iterator(self):
            return iter(list(kept.items()))

    s = held.Sites(0, 0)
    s.held = s.spans = State()
    old = {(p, b): 1 for p in range(1000) for b in "ACGT"}
    s._store(s.held, {}, old)
    assert len(calls) == 4 and s._stored()[0] == old
    new = {k: n for k, n in old.items() if k[0] >= 256} | {(999, "A"): 5}
    calls.clear()
    s._store(s.held, old, new)
    assert sorted(calls) == [(0,), (3,)] and s._stored()[0] == new
