"""Operator 7 against brute force."""

import numpy as np
import pytest

pytest.importorskip("varispark.llm")

from varispark.llm import neighbours as N  # noqa: E402


def brute(rows, threshold=0.9):
    ok = []
    for i, x in rows:
        good = i is not None and x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)
        ok.append(np.array(x, float) if good else None)
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return [(i, n[a], least.get(find(a))) for a, (i, _) in enumerate(rows)]


def sample():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 16))
    near = [b + rng.normal(size=16) * s for b, s in zip(np.repeat(base[:20], 3, axis=0), np.tile([0.1, 0.3, 0.45], 20), strict=True)]
    crowd = base[40] + rng.normal(size=(90, 16)) * 0.15  # more links than a list holds
    vectors = [*base, *near, *crowd, base[3], base[3], 2 * base[5], -base[6]]
    rows = [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(len(vectors)) + 10, vectors, strict=True)]
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [None] + [1.0] * 15), (5, [float("nan")] * 16), (6, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (7, [1.0, 2.0]), (8, [1.0, 2.1])]
    return rows + odd


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, label int, h int, s double").repartition(3)


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 32)
    monkeypatch.setattr(N, "MEET", 16)
    rows = sample()
    got = N.near_vectors(table(spark, rows)).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def test_copies_are_one_node_and_empty_table(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(9, [1.0, 2.0, 3.0])]
    got = N.near_vectors(table(spark, rows)).collect()
    assert len(got) == 51 and {(r["n_links"], r["component_id"]) for r in got} == {(50, 0)}
    assert N.near_vectors(table(spark, rows).limit(0)).count() == 0


def columns(got):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


def test_links_between_families_that_fill_each_others_lists(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    off = rng.normal(size=16)
    off -= base * (off @ base) / (base @ base)
    off *= np.linalg.norm(base) / np.linalg.norm(off)
    centers = [base, base + 0.4 * off]  # 0.93 apart, members about 0.99
    vectors = [c + rng.normal(size=16) * 0.1 for c in centers for _ in range(40)]
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(vectors)]
    want = sorted(brute(rows))
    assert min(n for _, n, _ in want) > 40  # links across as well as within
    assert columns(N.near_vectors(table(spark, rows)).collect()) == want


def test_low_recall_compares_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "ORDERS", 1)
    monkeypatch.setattr(N, "RETRIES", 0)
    rows = [r for r in sample() if r[0] is not None]
    assert columns(N.near_vectors(table(spark, rows), rounds=0).collect()) == sorted(brute(rows))


def test_very_large_and_very_small_vectors_link(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-170, 0.0]), (4, [1.0, 0.0]), (5, [-1e300, 1e-300]), (6, [5e-324, 0.0])]
    got = N.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert columns(got) == [(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (5, 0, 5), (6, 2, 3)]


def test_vectors_that_share_a_hash_stay_apart(spark, monkeypatch):
    class Half:
        """128 bits of hash of which the first 64 are all the same."""

        def __getattr__(self, name):
            import xxhash as real

            return (lambda x: bytes(8) + real.xxh3_128_digest(x)[8:]) if name == "xxh3_128_digest" else getattr(real, name)

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(12)] + [(20, [1.0] * 8), (21, [1.0] * 8)]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(N, "xxhash", Half())
    every = N.apart(N.nodes_of(table_)).collect()
    assert len({r["h"] for r in every}) == 13


def test_rounding_bounds_the_byte_cosines():
    rng = np.random.default_rng(4)
    for d in (3, 64, 1024):
        raw = [rng.normal(size=d).tobytes() for _ in range(40)]
        worst = max(map(N.rounding, raw))
        true, bytes_ = N.cosines(raw, "f8"), N.cosines([N.to_bytes(x) for x in raw], "i1")
        turn = np.abs(np.arccos(np.clip(true, -1, 1)) - np.arccos(np.clip(bytes_, -1, 1)))
        assert turn[~np.eye(40, dtype=bool)].max() <= 2 * np.arcsin(worst) + 1e-4


def test_query_by_column_and_type(spark):
    out = N.op7_query(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert columns(out.collect()) == sorted(brute(rows))


def test_recall_is_of_each_vector(spark):
    """One family with all its links and five pairs without theirs: the mean over nodes sees the pairs."""
    rng = np.random.default_rng(6)
    family = [np.ones(8) + rng.normal(size=8) * 0.01 for _ in range(10)]
    pairs = [v for b in np.eye(8)[:5] for v in (b, b + 0.01)]
    vectors = [(i, 1, np.asarray(v, "<f8").tobytes()) for i, v in enumerate([*family, *pairs])]
    nodes = spark.createDataFrame([(h, w, bytearray(x)) for h, w, x in vectors], "h long, w long, raw binary")
    counts = spark.createDataFrame([(i, 1, 9 if i < 10 else 0) for i in range(20)], "h long, w long, links long")
    assert abs(N.audit(nodes, counts, 0.9) - 0.5) < 1e-9


def test_audit_weighs_those_without_links_by_their_number(spark):
    """Of 30 pairs among 1,000 vectors half are missed altogether: found ones alone would show a recall of 1."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(970, 24))
    vectors = [*base, *(base[:30] + rng.normal(size=(30, 24)) * 0.05)]
    nodes = spark.createDataFrame([(h, 1, bytearray(np.asarray(v, "<f8").tobytes())) for h, v in enumerate(vectors)], "h long, w long, raw binary")
    counts = spark.createDataFrame([(h, 1, int(h % 970 < 15 if h >= 970 else h < 15)) for h in range(1000)], "h long, w long, links long")
    assert N.audit(nodes, counts, 0.9, (200, 5000)) == pytest.approx(0.5, abs=0.02)
    assert 0.3 < N.audit(nodes, counts, 0.9, (20, 400)) < 0.75
    assert N.audit(nodes, counts.withColumn("links", counts["links"] * 0), 0.9, (200, 5000)) == 0.0


def planted(seed=11, d=32):
    """(rows, class of each vector): pairs, chains whose ends don't link, families of 25 and vectors alone."""
    rng = np.random.default_rng(seed)
    turn = lambda v, cos: v * cos + (lambda o: o / np.linalg.norm(o))((lambda o: o - v * (o @ v) / (v @ v))(rng.normal(size=d))) * np.linalg.norm(v) * np.sqrt(1 - cos * cos)
    vectors, kinds = [], []
    for _ in range(60):
        v = rng.normal(size=d)
        vectors += [v, turn(v, 0.93)]
        kinds += ["pair"] * 2
    for _ in range(12):
        v = rng.normal(size=d)
        for _ in range(8):
            vectors.append(v)
            kinds.append("chain")
            v = turn(v, 0.94)
    for _ in range(6):
        v = rng.normal(size=d)
        vectors += [turn(v, 0.985) for _ in range(25)]
        kinds += ["family"] * 25
    vectors += list(rng.normal(size=(400, d)))
    kinds += ["alone"] * 400
    order = rng.permutation(len(vectors))
    return [(int(i), np.float32(v).tolist()) for i, v in zip(order, vectors, strict=True)], dict(zip(order.tolist(), kinds, strict=True))


def test_recall_by_class_of_planted_links(spark):
    rows, kind = planted()
    want = {i: (n, c) for i, n, c in brute(rows)}
    got = {r["vec_id"]: r for r in N.near_vectors(table(spark, rows)).collect()}
    for k in ("pair", "chain", "family"):
        own = [i for i in kind if kind[i] == k]
        assert sum(got[i]["n_links"] for i in own) >= 0.95 * sum(want[i][0] for i in own), k
    assert all(got[i]["n_links"] <= want[i][0] for i in kind)
    assert min(want[i][0] for i in kind if kind[i] == "family") > N.K  # lists that had to grow
    assert got[0]["recall"] >= N.RECALL


def test_full_lists_grow_before_anything_is_compared_in_blocks(spark, monkeypatch):
    rows, kind = planted(5)
    asked = []
    real = N.placed

    def seen(full, *more):
        asked.append(full.count())
        return real(full, *more)

    monkeypatch.setattr(N, "placed", seen)
    want = sorted(brute(rows))
    assert columns(N.near_vectors(table(spark, rows)).collect()) == want
    assert asked == [0]  # families of 25 fit into lists of 40
    assert columns(N.near_vectors(table(spark, rows), most=N.K).collect()) == want
    assert asked[1] >= 150
