"""The BAM source: splits, regions, pushed filters and columns, against a plain reading of the same bytes."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from varispark.sources import bam as B
from varispark.sources import binary

REFS = [("chr1", 40_000), ("chr2", 20_000), ("7", 9_000)]


def rows(n=3000):
    rng = random.Random(1)
    out = []
    for i in range(n):
        ref, size = rng.choice(REFS)
        k = rng.randrange(1, 60)
        cigar = rng.choice([f"{k}M", f"2S{k}M", f"{k}M500N4M", f"3M2D{k}M", f"1M2I{k}M1H"])
        length = sum(int(a) for a, b in B.re.findall(r"(\d+)([MIS])", cigar))
        name, pos, flag = (ref, rng.randrange(1, size), 0) if i % 50 else ("*", 0, 4)
        seq = "".join(rng.choices("ACGTN", k=length))
        qual = [rng.randrange(2, 41) for _ in seq] if i % 9 else None
        out.append((f"r{i}", flag, name, pos, rng.randrange(61), cigar if i % 50 else None, "=" if i % 3 and i % 50 else "*", pos + 5, seq, qual, {"NM": str(i % 5), "RG": "a b"} if i % 4 else {}))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "out")
    B.write_bam(spark.createDataFrame(rows(), B.SCHEMA).repartition(3), path, REFS, step=2000, block=4000)
    return path


def key(r):
    return tuple(tuple(x) if isinstance(x, list) else tuple(sorted(x.items())) if isinstance(x, dict) else x for x in r)


def reached(cigar, pos):
    return pos + max(1, sum(int(a) for a, b in B.re.findall(r"(\d+)([MDN=X])", cigar or ""))) - 1


def test_round_trip_in_several_tasks(spark, written):
    whole = B.bam(spark, written, split=4000)
    assert whole.rdd.getNumPartitions() > 6
    got = sorted((key(r) for r in whole.collect()), key=str)
    assert got == sorted((key(r) for r in rows()), key=str)
    assert not [p.name for p in __import__("pathlib").Path(written).iterdir() if p.name.startswith("_")]


def test_equal_to_the_reading_in_one_task(spark, written):
    names = ["qname", "flag", "rname", "pos", "mapq", "pnext"]
    want = sorted(tuple(r) for r in binary.bam(spark, f"{written}/*.bam").select(names).collect())
    assert sorted(tuple(r) for r in B.bam(spark, written, names, split=3000).collect()) == want


@pytest.mark.parametrize("region", ["chr1", "chr1:5000-6000", "2:100", "chr7:1-8,999", "chr1:39,990", "chr9:1-5"])
def test_regions_are_those_that_reads_touch(spark, written, region):
    chrom, _, span = region.partition(":")
    chrom = next((n for n, _ in REFS if n in (chrom, B.other_name(chrom))), None)
    a, _, b = span.replace(",", "").partition("-")
    want = {r[0] for r in rows() if r[2] == chrom and r[3] <= int(b or 10**9) and reached(r[5], r[3]) >= int(a or 0)}
    assert {r["qname"] for r in B.bam(spark, written, ["qname"], region, split=2000).collect()} == want


def plan(reader):
    return [(p.path, p.first, p.stop) for p in reader.partitions() if p.path]


def test_filters_open_only_their_segments(spark, written):
    schema = B.StructType.fromDDL("qname string, rname string, pos int")
    every = B.BamReader({"path": written, "split": "1"}, schema)
    some = B.BamReader({"path": written, "split": "1"}, schema)
    list(some.pushFilters([B.EqualTo(("rname",), "chr2"), B.GreaterThan(("pos",), 9000), B.LessThanOrEqual(("pos",), 9400)]))
    all_parts, few = plan(every), plan(some)
    assert 0 < len(few) <= 4 and set(few) < set(all_parts) and len(all_parts) > 20
    want = {(r[0], r[2], r[3]) for r in rows() if r[2] == "chr2" and 9000 < r[3] <= 9400}
    got = [r for p in some.partitions() for b in some.read(p) for r in b.to_pylist()]
    assert {tuple(r.values()) for r in got} == want
    fetched = 0
    for path, first, stop in few:
        f = B.Ranged(path, None if stop is None else (stop >> 16) + 0x10000, ahead=1)
        assert sum(1 for _ in B.records(f, first, stop))
        fetched += f.fetched
    total = sum(p.stat().st_size for p in __import__("pathlib").Path(written).glob("*.bam"))
    assert fetched < total / 4
    df = B.bam(spark, written, ["qname", "rname", "pos"]).where("rname = 'chr2' and pos > 9000 and pos <= 9400")
    assert {tuple(r) for r in df.collect()} == want


def test_index_of_other_files_and_unsorted_ones(spark, tmp_path):
    refs = [("chr1", 1000)]
    made = [(f"q{i}", 0, 0, p, 9, [(4, "M")], "ACGT", [30] * 4) for i, p in enumerate([*range(1, 900), 5])]
    for name, given in (("sorted", made[:-1]), ("unsorted", made)):
        path = str(tmp_path / f"{name}.bam")
        plain = b"".join(binary.bgzf(binary.encode_bam(refs, given)))
        with open(path, "wb") as f:
            out = B.Output(f)
            for i in range(0, len(plain), 700):  # blocks that records cross
                out.held += plain[i : i + 700]
                out.flush(700)
            out.close()
        assert B.bam(spark, path).count() == len(given)  # without an index: one task
        B.build_index(spark, [path], step=900)
        df = B.bam(spark, path, split=900)
        assert sorted(r["qname"] for r in df.collect()) == sorted(r[0] for r in given)
        assert (df.rdd.getNumPartitions() > 5) == (name == "sorted")
        assert B.bam(spark, path, ["pos"], "1:500-503", split=900).count() == 7


def test_existing_folders_and_bad_rows_are_errors(spark, written, tmp_path):
    with pytest.raises(Exception, match="exists"):
        B.write_bam(spark.createDataFrame(rows(5), B.SCHEMA), written, REFS)
    bad = spark.createDataFrame(rows(3), B.SCHEMA).withColumn("qual", F.array(F.lit(3)))
    with pytest.raises(Exception, match="bad sequence or quality"):
        B.write_bam(bad, str(tmp_path / "bad"), REFS)
    assert not [p for p in tmp_path.rglob("*.bam")]
    with pytest.raises(ValueError):
        B.dictionary(__file__)


def test_every_kind_of_tag():
    raw = b"AAAx" + b"BBc\xff" + b"CCS" + struct.pack("<H", 7) + b"DDf" + struct.pack("<f", 0.5) + b"EEZhi\0" + b"FFBs" + struct.pack("<ihh", 2, -1, 3)
    assert B._tags(raw) == [("AA", "x"), ("BB", "-1"), ("CC", "7"), ("DD", "0.5"), ("EE", "hi"), ("FF", "s,-1,3")]


def test_scans_have_a_bounded_number_of_tasks(spark, written, monkeypatch):
    monkeypatch.setattr(B, "TASKS", 5)
    reader = B.BamReader({"path": written, "split": "1"}, B.StructType.fromDDL("qname string"))
    parts = reader.partitions()
    assert len(parts) <= 5 + len(reader._files())
    assert sorted(r["qname"] for p in parts for b in reader.read(p) for r in b.to_pylist()) == sorted(r[0] for r in rows())


def test_reads_are_made_once_for_writing(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seq(n):
        made.add(1)
        return "A" * n

    reads = spark.range(1, 200, 1, 3).select(F.lit("chr1").alias("rname"), F.col("id").cast("int").alias("pos"), seq((F.col("id") % 9).cast("int")).alias("seq"))
    B.write_bam(reads, str(tmp_path / "once"), [("chr1", 1000)])
    assert made.value == 199
