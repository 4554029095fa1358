"""Streams of sorted reads: sites come out once they are final, late ones are dropped, duplicates once."""

import time

from pyspark.sql import functions as F

from varispark.streaming import frontier


def stream(spark, folder, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.05 if k else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(df, folder):
    df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect()


def test_sites_are_final_behind_the_frontier(spark, tmp_path):
    rows = [[(5, "A"), (5, "A"), (6, "C"), (9, "G")], [(9, "G"), (20, "T")], [(7, "A"), (30, "T")]]
    out = run(frontier.pileup(stream(spark, tmp_path, "pos long, base string", rows), 0), tmp_path)
    got = {(r["pos"], r["base"]): r["n"] for r in out}
    assert got == {(5, "A"): 2, (6, "C"): 1, (9, "G"): 2, (20, "T"): 1}  # 7 came late, 30 may still grow


def test_lateness_waits_for_open_deletions(spark, tmp_path):
    rows = [[(5, "A"), (20, "C")], [(7, "A"), (30, "T")], [(60, "T")]]
    out = run(frontier.pileup(stream(spark, tmp_path, "pos long, base string", rows), 15), tmp_path)
    assert {(r["pos"], r["base"]) for r in out} == {(5, "A"), (7, "A"), (20, "C"), (30, "T")}


def test_duplicates_within_a_span(spark, tmp_path):
    rows = [[("a", "c", 5, "+"), ("b", "c", 5, "+"), ("a", "c", 5, "-")], [("a", "c", 5, "+"), ("z", "c", 9, "+")]]
    out = run(frontier.distinct_reads(stream(spark, tmp_path, "qname string, rname string, pos long, strand string", rows), 100), tmp_path)
    assert sorted((r["qname"], r["strand"]) for r in out) == [("a", "+"), ("a", "-"), ("b", "+"), ("z", "+")]


def test_stream_and_batch_pileups_agree(spark, tmp_path):
    rows = [[(p, "ACGT"[(p * k) % 4]) for k in range(6)] for p in range(1, 7)]
    s = stream(spark, tmp_path, "pos long, base string", rows)
    got = {(r["pos"], r["base"]): r["n"] for r in run(frontier.pileup(s, 0), tmp_path)}
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy("pos", "base").agg(F.count("*").alias("n")).collect()
    assert got == {(r["pos"], r["base"]): r["n"] for r in batch if r["pos"] < 6}


LENGTHS = {"chr2": 40, "chr10": 60, "chr1": 30}


def test_next_chromosome_makes_the_last_one_final(spark, tmp_path):
    rows = [[("chr2", 5, "A"), ("chr2", 39, "C")], [("chr10", 2, "G"), ("chrUn", 1, "T")], [("chr10", 3, "G")], [("chr2", 39, "C"), ("chr1", 1, "T")]]
    s = stream(spark, tmp_path, "chrom string, pos long, base string", rows)
    got = {(r["chrom"], r["pos"], r["base"]): r["n"] for r in run(frontier.pileup(s, 0, LENGTHS), tmp_path)}
    # chr1 may still grow, chrUn has no place, and the second observation of chr2 came a batch after its site was final
    assert got == {("chr2", 5, "A"): 1, ("chr2", 39, "C"): 1, ("chr10", 2, "G"): 1, ("chr10", 3, "G"): 1}


def test_lateness_does_not_reach_over_chromosomes(spark, tmp_path):
    rows = [[("chr2", 38, "A")], [("chr10", 9, "G")], [("chr10", 1, "C")], [("chr1", 30, "T")]]
    s = stream(spark, tmp_path, "chrom string, pos long, base string", rows)
    got = {(r["chrom"], r["pos"], r["base"]) for r in run(frontier.pileup(s, 15, LENGTHS), tmp_path)}
    assert got == {("chr2", 38, "A"), ("chr10", 9, "G"), ("chr10", 1, "C")}


def test_pairs_and_duplicates_over_chromosomes(spark, tmp_path):
    rows = [[("a", "chr2", 5, "+"), ("a", "chr2", 5, "+"), ("b", "chr2", 39, "+")], [("a", "chr10", 5, "+"), ("b", "chr10", 1, "-"), ("a", "chr10", 8, "-")]]
    s = stream(spark, tmp_path, "qname string, rname string, pos long, strand string", rows)
    got = run(frontier.distinct_reads(s, 10, LENGTHS), tmp_path)
    assert sorted((r["qname"], r["rname"], r["pos"]) for r in got) == [("a", "chr10", 5), ("a", "chr10", 8), ("a", "chr2", 5), ("b", "chr10", 1), ("b", "chr2", 39)]
    r = spark.createDataFrame([x for batch in rows for x in batch], "qname string, chrom string, pos long, strand string").dropDuplicates()
    near = frontier.pairs(r.where("strand = '+'"), r.where("strand = '-'"), 10, LENGTHS).collect()
    assert [tuple(x) for x in near] == [("a", "chr10", 5, 8)]  # b's mates lie on two chromosomes
