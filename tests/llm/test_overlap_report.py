"""The overlap report of both splits."""

from loomgate.functions.text import plain
from loomgate.llm.queries import p1_found, p1_members, p1_report


def test_both_splits_are_reported(spark, sf_dir):
    """Actions in the pairs of p1_found, counted on both sides of the split."""
    from pyspark.sql import functions as F

    found = {e for r in p1_found(spark, sf_dir).collect() for e in (r["event_id_a"], r["event_id_b"])}
    split = spark.read.parquet(f"{sf_dir}/event_manifest.parquet").select("event_id", "split", plain(F.col("source")).alias("source")).distinct().collect()
    want = {}
    for r in split:
        if r["event_id"] in found:
            want[(r["split"], r["source"])] = want.get((r["split"], r["source"]), 0) + 1
    got = {(r["split"], r["source"]): (r["n_actions"], r["n_overlapping"]) for r in p1_report(spark, sf_dir).collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == want
    assert {k[0] for k in want} == {"calibration", "evaluation"}
    assert {r["event_id"] for r in p1_members(spark, sf_dir).collect() if r["n_links"]} == found
