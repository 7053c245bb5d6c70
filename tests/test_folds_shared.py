"""Many short keys share a call of a fold."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.plans import folds


def _calls(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(folds, "BUCKET_ROWS", bucket_rows)
    df = spark.range(3000).select((F.col("id") / 3).cast("long").alias("recording_id"), (F.col("id") % 3).alias("n"), F.array(F.struct(F.col("id").alias("x"))).alias("kept"))
    df = df.unionByName(df.where("recording_id = 1").withColumn("recording_id", F.lit(None).cast("long")))
    out = T.StructType([df.schema["recording_id"], df.schema["n"], df.schema["kept"], T.StructField("upto", T.LongType())])

    def fold(rows, state):
        assert "kept" not in rows.columns and len(rows) == 3
        return {"upto": np.cumsum(rows["n"].to_numpy() + 1)}, state

    done = folds.fold_blocks(df, ["recording_id"], "n", fold, out, [0.0], reads=["n"])
    rows = done.collect()
    assert len(rows) == 3003 and sum(r["recording_id"] is None for r in rows) == 3
    assert all(r["upto"] == (r["n"] + 1) * (r["n"] + 2) / 2 and r["kept"][0]["x"] == 3 * (1 if r["recording_id"] is None else r["recording_id"]) + r["n"] for r in rows)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    return plan


def test_short_keys_share_a_call(spark, monkeypatch):
    for bucket_rows in (100, 65536):
        assert "FlatMapGroupsInArrow [_bucket" in _calls(spark, monkeypatch, bucket_rows)
