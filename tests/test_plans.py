"""Blocked windows and folds give what a plain pass over the whole key gives."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.plans import folds, ordered, store


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(k, n, rnd.choice(["a", "b", None]), rnd.randint(1, 9))
            for k in (1, 2) for n in sorted(rnd.sample(range(400), 150))]
    return spark.createDataFrame(data, "recording_id long, seg_no long, speaker string, v long").cache()


@pytest.mark.parametrize("block", [3, 50, 4096])
def test_in_order_is_a_window(rows, block, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", block)
    keys = ["recording_id"]
    got = ordered.in_order(
        rows, keys, ["seg_no"], lag={"l1": F.col("v")}, lag2={"l2": F.col("v")}, lead={"n1": F.col("v")},
        sums={"s": F.col("v")}, last={"f": F.col("speaker")}, before={"b": F.col("speaker")},
        islands=("i", {"x": F.col("speaker")}, lambda a, b: ~a["x"].eqNullSafe(b["x"])))
    w = Window.partitionBy(*keys).orderBy("seg_no")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({
        "l1": F.lag("v").over(w), "l2": F.lag("v", 2).over(w), "n1": F.lead("v").over(w), "s": F.sum("v").over(upto),
        "f": F.last("speaker", ignorenulls=True).over(upto), "b": F.last("speaker", ignorenulls=True).over(earlier),
        "_p": F.lag(F.struct("speaker")).over(w)})
    want = want.withColumn("_o", (F.col("_p").isNotNull() & ~F.col("_p.speaker").eqNullSafe(F.col("speaker"))).cast("int"))
    want = want.withColumn("i", F.sum("_o").over(upto)).drop("_p", "_o").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_fold_blocks_settles_across_blocks(spark):
    rnd = random.Random(5)
    data = [(k, n, rnd.randint(1, 7)) for k in (1, 2, 3) for n in range(300)]
    df = spark.createDataFrame(data, "recording_id long, n long, v long")
    out = T.StructType([df.schema["recording_id"], df.schema["n"], T.StructField("opens", T.BooleanType())])

    def fold(pdf, state):
        width, marks = state[0], []
        for v in pdf["v"]:
            marks.append(width == 0)
            width = 0 if width + v >= 20 else width + v
        return pdf.assign(opens=marks)[["recording_id", "n", "opens"]], [width]

    def run(rows_per_block):
        return sorted(map(tuple, folds.fold_blocks(df, ["recording_id"], "n", fold, out, [0.0], block_rows=rows_per_block).collect()))

    assert run(7) == run(16384)


def test_no_block_exceeds_its_rows(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("n"))
    out = T.StructType([df.schema["recording_id"], T.StructField("size", T.LongType())])

    def fold(pdf, state):
        return pd.DataFrame({"recording_id": [1], "size": [len(pdf)]}), state

    sizes = [r["size"] for r in folds.fold_blocks(df, ["recording_id"], "n", fold, out, [0.0], block_rows=64).collect()]
    assert max(sizes) == 64 and sum(sizes) == 1000


def test_a_job_leaves_no_folder(spark):
    with store.scratch(spark):
        df = store.materialise(spark.range(5))
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").removeprefix("//")
        assert os.path.isdir(path) and df.count() == 5
    assert not os.path.exists(path)


def test_a_local_session_without_a_folder_gets_one():
    """Nothing is set in the session, which would refuse it; every call gives the same folder."""
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return "local[2]" if name == "spark.master" else default

        class sparkContext:
            applicationId = "local-test"

    one = store.shared_dir(Session)
    assert os.path.isdir(one) and store.shared_dir(Session) == one
