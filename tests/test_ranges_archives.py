"""Indexed FASTA and 2-bit files by ranges, zip members and ABI traces against plain readings."""

import random
import zipfile

import pytest

from varispark.sources import archives, binary, ranges, text

RNG = random.Random(2)
SEQS = {"chr1": "".join(RNG.choices("ACGTacgtN", k=1003)), "chr2": "", "3": "".join(RNG.choices("ACGT", k=120)), "m": "A"}


def chunks(seqs, size):
    return sorted((n, i + 1, s[i : i + size]) for n, s in seqs.items() for i in range(0, len(s), size))


def got(df):
    return sorted((r["chrom"], r["chunk_start"], r["bases"]) for r in df.collect())


@pytest.mark.parametrize("width,end", [(60, "\n"), (7, "\r\n"), (2000, "\n")])
def test_fasta_ranges_equal_the_whole_reading(spark, tmp_path, width, end):
    path = f"{tmp_path}/x.fa"
    with open(path, "w", newline="") as f:
        f.write("".join(f">{n} about it{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in SEQS.items()))
    ranges.build_fai(spark, [path])
    for size, run in ((10, 3), (64, 1), (5000, 8)):
        df = ranges.fasta_ranges(spark, [path], size, run=run)
        assert got(df) == chunks(SEQS, size) == got(text.chunked(text.fasta(spark, path), size))
    some = ranges.fasta_ranges(spark, [path], 10, region=("1", 95, 5000))
    assert got(some) == [c for c in chunks({"chr1": SEQS["chr1"]}, 10) if c[1] >= 91]
    assert got(ranges.fasta_ranges(spark, [path], 10, region=("chr3", 11, 20))) == [("3", 11, SEQS["3"][10:20])]
    assert got(ranges.fasta_ranges(spark, [path], 10, region=("chr3", 121, 200))) == []


def test_uneven_lines_and_wrong_indexes_are_errors(spark, tmp_path):
    (tmp_path / "bad.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="differ in length"):
        ranges.build_fai(spark, [f"{tmp_path}/bad.fa"])
    (tmp_path / "cut.fa").write_text(">a\nACGT\n")
    (tmp_path / "cut.fa.fai").write_text("a\t40\t3\t4\t5\n")
    with pytest.raises(Exception, match="doesn't fit its index"):
        ranges.fasta_ranges(spark, [f"{tmp_path}/cut.fa"], 8).collect()


def test_two_bit_ranges_equal_the_whole_reading(spark, tmp_path):
    path = f"{tmp_path}/g.2bit"
    with open(path, "wb") as f:
        f.write(binary.encode_2bit({n: s for n, s in SEQS.items()}))
    for size, run in ((4, 7), (64, 2), (4096, 1)):
        assert got(ranges.two_bit_ranges(spark, [path], size, run=run)) == chunks(SEQS, size)
    assert got(ranges.two_bit_ranges(spark, [path], 8, region=("chr1", 1000, 2000))) == [c for c in chunks({"chr1": SEQS["chr1"]}, 8) if c[1] >= 993]
    with pytest.raises(ValueError):
        ranges.two_bit_ranges(spark, [path], 10)


def test_members_of_archives_are_read_by_any_source(spark, tmp_path):
    for a in range(3):
        with zipfile.ZipFile(tmp_path / f"{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("lists/one.txt", "".join(f"line {a} {i}\n" for i in range(50)))
            z.writestr("two.txt", f"last {a}")
            z.writestr("skip.bin", b"\x00" * 10)
            z.writestr("lists/", "")
    found = archives.members(spark, str(tmp_path)).collect()
    assert len(found) == 9 and sum(r["size"] for r in found if r["member"] == "skip.bin") == 30
    lines = spark.read.text(archives.unpacked(spark, str(tmp_path), "*.txt")).collect()
    assert len(lines) == 153 and sum(r["value"].startswith("last") for r in lines) == 3
    assert spark.read.text(archives.unpacked(spark, f"{tmp_path}/1.zip", "two*")).collect()[0]["value"] == "last 1"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(Exception, match="outside of itself"):
        archives.unpacked(spark, f"{tmp_path}/bad.zip")


def test_written_archives_hold_lines_in_order(spark, tmp_path):
    rows = [(a, m, i, f"{a}{m}{i}") for a in "xy" for m in "pq" for i in range(20)]
    df = spark.createDataFrame(rows, "archive string, member string, i int, value string").repartition(5)
    archives.write_zips(df, f"{tmp_path}/z")
    for a in "xy":
        with zipfile.ZipFile(f"{tmp_path}/z/{a}.zip") as z:
            assert {n: z.read(n).decode() for n in z.namelist()} == {m: "".join(f"{a}{m}{i}\n" for i in range(20)) for m in "pq"}


def test_abi_traces(spark, tmp_path):
    channels, bases, places = [[1, 2, 3, 300], [0, 0, 9, 9], [-1, 5, 6, 7], [8, 8, 8, 8]], "ACNT", [0, 1, 2, 3]
    for order in ("GATC", "ACGT"):
        raw = binary.encode_abi(channels, bases, places, order)
        assert list(binary.decode_abi("a/b.ab1", raw)) == [("b.ab1", *channels, bases, places)]
        assert list(binary.decode_abi("b.ab1", bytes(128) + raw)) == [("b.ab1", *channels, bases, places)]
    one = binary.encode_abi([[5], [6], [7], [8]], "A", [0])  # all records within their entries
    (tmp_path / "t.ab1").write_bytes(one)
    assert [tuple(r) for r in binary.abi(spark, f"{tmp_path}/t.ab1").collect()] == [("t.ab1", [5], [6], [7], [8], "A", [0])]
    with pytest.raises(ValueError):
        list(binary.decode_abi("x", b"nothing of the kind" * 20))
