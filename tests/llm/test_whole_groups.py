"""Groups stay whole in tasks when the adaptive execution splits a join before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.llm import substrings


def test_sorted_groups_after_a_join(spark, tmp_path):
    rows = spark.range(400).select(
        (F.col("id") % 100).alias("g"), F.lit(0).cast("long").alias("g2"), F.col("id").alias("k"), F.lit(0).alias("low"), F.lit(4).alias("high"),
        F.lit(b"abcd").alias("before"), F.concat(F.lit("xy"), F.col("id").cast("string")).cast("binary").alias("after"),
    )
    rows.repartition(4).write.parquet(f"{tmp_path}/rows")
    rows.select("g", "g2").distinct().write.parquet(f"{tmp_path}/keys")
    adaptive = "spark.sql.adaptive."
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", f"{adaptive}skewJoin.skewedPartitionThresholdInBytes": "1",
        f"{adaptive}skewJoin.skewedPartitionFactor": "0.1", f"{adaptive}advisoryPartitionSizeInBytes": "1k",
    }
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        few = spark.read.parquet(f"{tmp_path}/rows").join(spark.read.parquet(f"{tmp_path}/keys"), ["g", "g2"])
        found = {(r.k, r.x, r.y) for r in substrings.sorted_groups(few).collect()}
    finally:
        for name in conf:
            spark.conf.unset(name)
    # The four rows of a group share "abcd" and "xy", and their digits differ at once or after one.
    after = {k: f"xy{k}" for k in range(400)}
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert found == {(k, 0, min(4, max(same(after[k], after[j]) for j in range(k % 100, 400, 100) if j != k))) for k in range(400)}
