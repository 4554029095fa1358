"""Operator 13 against a trie made of dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("varispark.llm")

from pyspark.sql import functions as F  # noqa: E402

from varispark.llm import trie as T  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[:h] + ts[h:] if rebuild else ts
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, b"") for r in rows], "conv_id long, turn long, role string, text string, depth int, seq binary").repartition(3)


def nodes(spark, rows, rebuild=True):
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 if rebuild else None
    out = T.prefix_trie(T.conversations(turns(spark, rows), shared))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def random_rows(seed, n, kinds=3, most=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "user", " ".join("word" for _ in range(rng.randrange(kinds)))))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_trie_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 3)
    rows = random_rows(seed, 120)
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, rows, rebuild=False) == brute(rows, rebuild=False)


@pytest.mark.parametrize("parts", [1, 7, 23])
def test_blocks_of_any_number_give_one_trie(spark, parts, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 2)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nested = [(100 + i, t, "user", f"t{t}") for i in range(25) for t in range(i)]  # every conversation starts the next
        copies = [(1000 + i, t, "user", f"c{t}") for i in range(60) for t in range(3)]  # one conversation again and again
        rows = nested + copies + [(5000 + c, *r) for c, *r in random_rows(9, 40)]
        assert nodes(spark, rows, rebuild=False) == brute(rows, rebuild=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_in_pure_python():
    """Any cut of any sorted list gives the chains of the whole list."""
    rng = random.Random(5)
    for _ in range(60):
        seqs = sorted((bytes(b for _ in range(rng.randint(0, 5)) for b in [rng.randrange(2)] * T.TURN), c) for c in range(rng.randint(1, 30)))
        rows = [(T.common_turns(seqs[i - 1][0], s) if i else -1, c, s, [3] * (len(s) // T.TURN)) for i, (s, c) in enumerate(seqs)]

        def chains(cuts, rows=rows):
            ends = [0, *cuts, len(rows)]
            made = [x for b, (i, j) in enumerate(zip(ends, ends[1:])) for x in T._block(b, iter(rows[i:j]))]
            left = sorted((x for x in made if x["kind"] in ("drop", "open")), key=lambda x: (x["pid"], x["at"]))
            made = [x for x in made if x["kind"] == "chain"] + list(T._joined(iter([dict.fromkeys(("seq", "words")) | x for x in left])))
            return sorted((x["node"], x["parent"] or b"", x["base"], x["low"], x["n"], x["children"], x["leaves"], x["saved"], x["before"]) for x in made)

        whole = chains([])
        assert chains(sorted(rng.sample(range(len(rows)), min(4, len(rows))))) == whole


def test_odd_rows(spark):
    rows = [
        (20, None, None, "first"), (20, 0, "user", None), (20, 1, "", ""), (20, 1, "", ""), (21, 5, "user", "x"), (22, 0, "u", "x" * 100_000), (22, 1, "u", "w " * 20_000),
        (None, 0, "user", "nobody"), (23, None, None, None), (24, None, None, None), (40, 1, "a:", "b"), (41, 1, "a", ":b"), (-3, 0, "user", "below zero"), (60, 0, "ünï", "wörds\x0bhere \x00"),
    ]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []


def test_only_turnless_conversations(spark):
    empty = T.conversations(turns(spark, [(c, 0, "user", "x") for c in (21, 22, 23, 25, 27)]), F.lit(1))
    got = [tuple(r) for r in T.prefix_trie(empty).collect()]
    assert got == [(21, 0, None, 5, 0, 1, 0, hashlib.sha256(b"21,22,23,25,27").hexdigest())]
