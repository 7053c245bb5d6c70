"""Recordings share a call when sections are found, and measures need no page."""

from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx
from colloquy.operators import jobs
from colloquy.operators import sections as se
from colloquy.operators import summarise as su
from colloquy.operators import terms as tm


def _notes(spark):
    words = ["river", "stone", "bridge", "garden", "winter", "market", "harbour"]
    rows = [(r, n, " ".join(words[(r + n * k) % 7] for k in range(1, 4 + (r + n) % 3)) if n else "", None) for r in range(30) for n in range(9)]
    return spark.createDataFrame(rows, "recording_id long, note_no long, text string, ts_start_ms long").cache()


def test_recordings_share_a_call(spark, monkeypatch):
    n = _notes(spark)
    w = tm.weights(n, None, ("note_no",)).cache()
    seen = []

    def label(rows, many, one, out):
        made = su.by_recording(rows, many, one, out)
        seen.append(made._jdf.queryExecution().optimizedPlan().toString())
        return made

    monkeypatch.setattr(se, "by_recording", label)
    got = sorted(map(tuple, se.discover_sections(n, w).collect()))
    assert len(got) == 270 and "FlatMapGroupsInArrow [_bucket" in seen[0]
    monkeypatch.setattr(su, "BUCKET_ROWS", 20)
    assert sorted(map(tuple, se.discover_sections(n, w).collect())) == got


def test_measures_without_the_page(spark):
    placed = _notes(spark).select("recording_id", F.lit("body").alias("part"), (F.col("note_no") % 2).alias("section"), F.lit(0).cast("long").alias("piece"),
                                  F.lit(None).cast("string").alias("kind"), "note_no", F.lit("fact").alias("type"), "text", "ts_start_ms")
    asked = spark.sparkContext.accumulator(0)

    def writer():
        def answer(text):
            asked.add(1)
            return "\n".join(x for x in text.split("\n") if x.startswith("- "))
        return answer

    recordings = placed.select("recording_id").distinct().withColumn("title", F.lit(""))
    got = sorted(map(tuple, jobs.measure_sections(placed, lx.kinds(spark), writer).collect()))
    assert asked.value == 60            # a section each, no abstract
    assert got == sorted(map(tuple, jobs.write_sections(placed, lx.kinds(spark), recordings, writer)[1].collect())) and len(got) == 30
