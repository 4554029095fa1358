"""Reads made from tables whose keys are large."""

import pyarrow as pa
import pyarrow.parquet as pq

from varispark.plans import fixtures
from varispark.plans.readsets import QUERIES

CHUNK = fixtures.CHUNK
SF = "/root/testdata/sf0.001"


def test_read_ids_of_large_keys(spark, tmp_path):
    """Keys of tables 360 times sf0.1, beyond which the sum of read_id leaves 64 bits."""
    line, part = pq.read_table(f"{SF}/lineitem.parquet"), pq.read_table(f"{SF}/part.parquet")
    add = lambda t, c, n: t.set_column(t.schema.get_field_index(c), c, pa.array([x + n for x in t[c].to_pylist()], pa.int64()))
    for c, n in (("l_orderkey", 359 * 150_000), ("l_partkey", 20_000), ("l_suppkey", 359 * 1000)):
        line = add(line, c, n)
    pq.write_table(line, tmp_path / "lineitem.parquet")
    pq.write_table(add(part, "p_partkey", 20_000), tmp_path / "part.parquet")
    ids = fixtures.reads(spark, str(tmp_path)).select("read_id").distinct().count()
    assert ids == line.group_by(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).aggregate([]).num_rows
    assert sum(r["n"] for r in QUERIES["f09_mismatch_filter"](spark, str(tmp_path)).collect()) > 0


def test_read_ids_of_small_keys(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    plain = line.selectExpr(fixtures._READ_ID + " AS read_id")
    assert sorted(plain.collect()) == sorted(fixtures.reads(spark, SF).select("read_id").collect())


def test_reference_is_made_in_batches(spark):
    """The bases of ref_index(), without a lambda for each base in the one task that knows how long it is."""
    r = fixtures.reference(spark, SF)
    assert "lambdafunction" not in r._jdf.queryExecution().optimizedPlan().toString()
    for x in r.where("chunk_start < 2000").collect():
        for i in (0, 1, 100, CHUNK - 1):
            q, c = x["chunk_start"] + i, int(x["chrom"][3:])
            assert x["bases"][i] == "ACGT"[0 if q // 12 % 9 == 0 else (q * 7 + q // 3 * 5 + c * 3 + q * q) % 4]
