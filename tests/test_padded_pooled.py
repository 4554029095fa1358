"""Padded consensus, thinning of deep sites and pooling against small versions in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from varispark.functions import batches
from varispark.operators import padded, reads

SCHEMA = "read_id long, rname string, pos int, cigar string, seq string, qual array<int>"


def brute(rows):
    gaps = {}
    for _, chrom, pos, cigar, *_ in rows:
        p = pos
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or ""):
            if op == "I":
                gaps[chrom, p] = max(gaps.get((chrom, p), 0), int(n))
            elif op in "M=XDN":
                p += int(n)

    def place(chrom, x):
        return x + sum(k for (c, p), k in gaps.items() if c == chrom and p <= x)

    out = {}
    for i, chrom, pos, cigar, seq, qual in rows:
        ops = re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")
        if not any(op in "M=X" for _, op in ops):
            continue
        cells, p, r, begun = {}, pos, 0, False
        for n, op in ops:
            n = int(n)
            if op in "M=XDN":
                for k in range(n):
                    at = place(chrom, p)
                    if begun or k:
                        for j in range(1, gaps.get((chrom, p), 0) + 1):
                            cells.setdefault(at - j, (">" if op == "N" else "*", None))
                    cells[at] = (seq[r], qual[r]) if op in "M=X" else (">" if op == "N" else "*", None)
                    r += op in "M=X"
                    p += 1
                begun = True
            elif op == "I":
                first = place(chrom, p) - (gaps[chrom, p] if begun else n)
                for k in range(n):
                    cells[first + k] = (seq[r], qual[r])
                    r += 1
            elif op == "S":
                r += n
        start = min(cells)
        assert sorted(cells) == list(range(start, start + len(cells)))
        out[i] = (start, [cells[x] for x in sorted(cells)])
    return gaps, place, out


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rng.choice(["", "3S", "2H1S"]), rng.choice(["", "", f"{rng.randrange(1, 4)}I"])]
        for _ in range(rng.randrange(1, 4)):
            parts.append(f"{rng.randrange(1, 9)}M")
            parts.append(rng.choice(["", f"{rng.randrange(1, 30)}I", f"{rng.randrange(1, 4)}D", f"{rng.randrange(1, 40)}N"]))
        cigar = "".join(parts[:-1])
        size = sum(int(k) for k, op in re.findall(r"(\d+)([MISX=])", cigar))
        rows.append((i, rng.choice(["a", "b"]), rng.randrange(1, 60), cigar, "".join(rng.choices("ACGT", k=size)), [rng.randrange(40) for _ in range(size)]))
    return [*rows, (n, "a", 5, None, None, None), (n + 1, "c", 5, "4M", "ACGT", [1, 2, 3, 4]), (n + 2, "a", 7, "*", "A", [1])]


@pytest.mark.parametrize("seed,chunk", [(1, 8), (2, 1024), (3, 3)])
def test_layout_and_coordinates(spark, seed, chunk):
    rows = made(seed)
    gaps, place, want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = padded.insertion_gaps(df)
    assert {(r["chrom"], r["pos"]): r["len"] for r in plan.collect()} == gaps
    got = {r["read_id"]: (r["padded_start"], [tuple(c) for c in r["cells"]]) for r in padded.layout(df, plan, chunk).collect()}
    assert got == want
    every = [(c, x) for c in "abc" for x in range(1, 200)]
    there = padded.to_padded(spark.createDataFrame(every, "chrom string, pos int"), plan, chunk).collect()
    assert {(r["chrom"], r["pos"]): r["padded"] for r in there} == {(c, x): place(c, x) for c, x in every}
    back = {(c, place(c, x)): x for c, x in every}
    back |= {(c, place(c, p) - j): None for (c, p), k in gaps.items() for j in range(1, k + 1)}
    most = {c: max(x for d, x in back if d == c) for c in "abc"}
    asked = [(c, x) for c in "abc" for x in range(1, most[c] + 1) if (c, x) in back]
    found = padded.to_reference(spark.createDataFrame(asked, "chrom string, padded long"), plan, chunk).collect()
    assert {(r["chrom"], r["padded"]): r["pos"] for r in found} == {k: back[k] for k in asked}


def test_text_and_cells(spark):
    rows = [(1, "a", 10, "3M2I2M", "ACGTTAC", [1, 2, 3, 4, 5, 6, 7]), (2, "a", 10, "5M", "ACGAC", [9] * 5), (3, "a", 10, "3M1I2M", "ACGGAC", [8] * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    laid = padded.layout(df, padded.insertion_gaps(df))
    at = padded.cell_at(F.col("cells"), F.col("padded_start"), F.lit(14).cast("long"))
    got = {r["read_id"]: (r["t"], r["c"] and tuple(r["c"])) for r in laid.select("read_id", padded.padded_text(F.col("cells")).alias("t"), at.alias("c")).collect()}
    assert got == {1: ("ACGTTAC", ("T", 5)), 2: ("ACG**AC", ("*", None)), 3: ("ACGG*AC", ("*", None))}


def test_thinned_sites_are_those_of_the_windows(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), rng.choice([1, 1, 1, 2, 3]), rng.choice("TN"), rng.choice("+-"), rng.randrange(9), rng.randrange(5), rng.choice([2, 15]), i) for i in range(900)]
    obs = spark.createDataFrame(rows, "chrom string, pos int, tn string, strand string, unclipped_start int, qual int, flank int, qname int").repartition(5)
    for limit, exempt in ((40, 3), (5, 10), (2000, 1)):
        strata, depth = {}, {}
        for r in rows:
            strata.setdefault((*r[:4], r[4] % 5), []).append(r)
            depth[r[:2]] = depth.get(r[:2], 0) + 1
        want = []
        for k, own in strata.items():
            own.sort(key=lambda r: (-r[5] * (100 if r[6] >= 10 else 1), r[7]))
            keep = len(own) if depth[k[:2]] <= limit or len(own) <= exempt else max(1, len(own) * limit // depth[k[:2]])
            want += own[:keep]
        out = reads.thin_deep_sites(obs, limit, exempt)
        assert out.columns == obs.columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    plan = reads.thin_deep_sites(obs, 40, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def dictionary(spark, *rows):
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(rows)], "rank int, name string, length long")


def test_only_like_sources_are_pooled(spark):
    a, b = dictionary(spark, ("x", 5), ("y", 6)), dictionary(spark, ("x", 5), ("y", 6))
    assert reads.check_poolable([a, b], ["coordinate"] * 2) == ["x", "y"]
    for other in (dictionary(spark, ("y", 6), ("x", 5)), dictionary(spark, ("x", 5)), dictionary(spark, ("x", 5), ("y", 7))):
        with pytest.raises(ValueError):
            reads.check_poolable([a, other], ["coordinate"] * 2)
        assert reads.check_poolable([a, other], ["coordinate"] * 2, one_reference=True) == ["x", "y"]
    with pytest.raises(ValueError):
        reads.check_poolable([a, b], ["coordinate", "queryname"])


def test_ties_go_to_the_first_source(spark):
    one = spark.createDataFrame([("y", 3, 7), ("x", 9, 1), ("*", 0, 2)], "rname string, pos int, read_id long")
    two = spark.createDataFrame([("y", 3, 1), ("x", 8, 5), ("x", 9, 0)], "rname string, pos int, read_id long")
    got = [(r["rname"], r["pos"], r["source_idx"]) for r in reads.pooled([one, two], ["y", "x"]).collect()]
    assert got == [("y", 3, 0), ("y", 3, 1), ("x", 8, 1), ("x", 9, 0), ("x", 9, 1), ("*", 0, 0)]
    assert reads.pooled([one, two], ["y", "x"], "x").count() == 3


def test_breaks_of_order_are_counted_across_pieces(spark):
    rows = [("f", 0, "y", 1), ("f", 0, "y", 5), ("f", 1, "y", 4), ("f", 1, "x", 1), ("f", 2, "x", 9), ("g", 0, "y", 2), ("g", 0, "y", 1), ("g", 1, "x", 1), ("g", 1, "y", 7)]
    df = spark.createDataFrame(rows, "file string, block long, rname string, pos int").coalesce(1)
    assert {r["file"]: r["breaks"] for r in reads.order_breaks(df, ["y", "x"]).collect()} == {"f": 1, "g": 2}


@pytest.mark.parametrize("seed,chunk", [(1, 8), (5, 1024)])
def test_consensus_counts_the_cells_of_all_reads(spark, seed, chunk):
    rows = made(seed)
    _, _, laid = brute(rows)
    want = {}
    for i, (start, cells) in laid.items():
        for k, (base, q) in enumerate(cells):
            n, total = want.get((rows[i][1], start + k, base), (0, None))
            want[rows[i][1], start + k, base] = n + 1, total if q is None else q + (total or 0)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = padded.consensus(df, padded.insertion_gaps(df), chunk).collect()
    assert {(r["chrom"], r["place"], r["base"]): (r["n"], r["qualities"]) for r in got} == want


def test_only_long_reads_gather_gaps_by_read(spark):
    """A read within two chunks meets its gaps in one join: its row, with sequence and qualities, isn't shuffled by read."""
    df = spark.createDataFrame(made(2), SCHEMA)
    plan = padded.layout(df, padded.insertion_gaps(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "SortMergeJoin LeftOuter, (read_id" not in plan


def test_cells_behind_the_start_are_those_of_the_layout(spark):
    """One cell a read, made once: no filter repeats what makes the cells."""
    df = spark.createDataFrame(made(4), SCHEMA)
    gaps = padded.insertion_gaps(df)
    some = padded.cells_behind_start(df, gaps, 13, 64)
    text = some._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in text
    cell = padded.cell_at(F.col("cells"), F.col("padded_start"), F.col("padded_start") + 13)
    whole = padded.layout(df, gaps, 64).select("read_id", cell.alias("c")).select("read_id", "c.base", "c.q")
    key = lambda r: (r["read_id"], r["base"] or "", -9 if r["q"] is None else r["q"])
    assert sorted(some.collect(), key=key) == sorted(whole.collect(), key=key)


def test_consensus_counts_reads_before_bases_are_rows(spark):
    """What leaves Python are sums by place: many reads at one place are a row for each of its bases."""
    rows = [(i, "chr1", 10, "4M", "ACGT", [30, 31, 32, 33]) for i in range(50)] + [(99, "chr1", 10, "4M", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = padded.consensus(df, padded.insertion_gaps(df))
    assert "Generate inline(pythonUDF" not in got._jdf.queryExecution().optimizedPlan().toString()
    known = {(r["place"], r["base"]): (r["n"], r["qualities"]) for r in got.where("base <> ''").collect()}
    assert known == {(10 + i, b): (50, 50 * (30 + i)) for i, b in enumerate("ACGT")}
    batch = df.limit(50).select(F.col("rname").alias("chrom"), "pos", "cigar", "seq", "qual").toArrow().combine_chunks().to_batches()[0]
    assert batches.counted_evidence(batch).num_rows == 4
