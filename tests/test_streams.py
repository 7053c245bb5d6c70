"""Recordings still being made: rows out of order, turns of any length, state that goes."""

import datetime as dt
import time
import uuid

import pytest

from conftest import SMALL

from colloquy.catalog import QUERIES
from colloquy.plans.store import shared_dir
from colloquy.streaming import live

START = dt.datetime(2026, 3, 1, 9, 0)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def arriving(spark, schema, *batches):
    """A stream whose micro-batches are the given rows."""
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream):
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    (stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").collect()


SEGMENTS = "recording_id long, seg_no long, ts timestamp, ts_end timestamp, text string"
TURNS = "recording_id long, turn long, turn_ts timestamp, turn_ts_end timestamp, speaker string"
END = [(-1, 0, at(10 ** 7), at(10 ** 7), "end")]
TURN_END = [(-1, 0, at(10 ** 7), at(10 ** 7), "X")]


def test_paragraphs_close_as_speech_goes_on(spark):
    """Late rows take their place; a paragraph ends at a pause or when it is full; each is given once."""
    rows = [(1, n, at(2 * n + (5 if n > 3 else 0)), at(2 * n + 1 + (5 if n > 3 else 0)), f"word{n}") for n in range(8)]
    early, late = [rows[i] for i in (1, 0, 3, 6)], [rows[i] for i in (2, 7, 4, 5)]
    later = [(1, 100, at(3600), at(3601), "again"), (1, 101, at(3601), None, None)]
    got = drained(live.live_paragraphs(arriving(spark, SEGMENTS, early, late, later, END), gap_ms=1200, max_chars=14))
    texts = [(r.started, r.segments, r.text) for r in sorted(got, key=lambda r: r.started)]
    assert texts == [(at(0), 3, "word0 word1 word2"), (at(6), 1, "word3"), (at(13), 3, "word4 word5 word6"), (at(19), 1, "word7"), (at(3600), 1, "again")]


def test_speakers_of_long_turns_gaps_and_openings(spark):
    segments = [(1, 0, at(0), at(5), ""), (1, 1, at(20), at(30), ""), (1, 2, at(7200), at(7210), ""), (1, 3, at(7300), at(7310), ""), (2, 0, at(3), at(4), "")]
    turns = [(1, 0, at(10), at(7205), "A"), (1, 1, at(24), at(26), "B"), (1, 2, at(7204), at(7210), "C")]
    got = drained(live.live_speakers(arriving(spark, SEGMENTS, segments, END), arriving(spark, TURNS, turns, TURN_END), forget="3 hours"))
    assert {(r.recording_id, r.seg_no): r.speaker for r in got} == {
        (1, 0): "A", (1, 1): "A", (1, 2): "C", (1, 3): "C", (2, 0): "SPEAKER_00"}       # opening; longest overlap; the one before; no turns


def test_a_piece_delivered_twice_is_taken_once(spark):
    schema = ("recording_id long, piece_no long, piece_start_ms long, started_at timestamp, "
              "segments array<struct<text:string,start_ms:long,end_ms:long,words:array<struct<word:string,start_ms:long,end_ms:long>>>>")
    one = (1, 0, 0, START, [("Hello", 0, 900, []), ("there.", 1000, 2000, [])])
    two = (1, 1, 30_000, START, [("Next", 0, 900, []), ("without a time", None, None, [])])
    end = (-1, 0, 0, at(10 ** 7), [("end", 0, 1, [])])
    turns = [(1, 0, at(0), at(3), "A"), (1, 1, at(29), at(40), "B")]
    got = drained(live.live_job(arriving(spark, schema, [one], [one, two], [end]), arriving(spark, TURNS, turns, TURN_END)))
    assert sorted((r.started, r.segments, r.speaker, r.text) for r in got) == [(at(0), 2, "A", "Hello there."), (at(30), 2, "B", "Next without a time")]


@pytest.mark.parametrize("forget, want", [("1 hour", "SPEAKER_00"), ("30 days", "Ada")])
def test_voices_are_forgotten_once_a_recording_is_over(spark, forget, want):
    schema = "recording_id long, seg_no long, ts timestamp, vector array<double>, learned string"
    first = [(1, 0, at(0), [1.0, 0.0], "Ada"), (1, 1, at(5), [0.9, 0.1], None)]
    between = [(2, 0, at(5 * 3600), [1.0, 1.0], None)]
    again = [(1, 2, at(10 * 3600), [1.0, 0.0], None)]
    got = {(r.recording_id, r.seg_no): r.speaker for r in drained(live.live_voices(arriving(spark, schema, first, between, again), forget=forget))}
    assert got == {(1, 0): "Ada", (1, 1): "Ada", (2, 0): "SPEAKER_00", (1, 2): want}


@pytest.mark.parametrize("name", ["live_paragraphs", "live_paragraphs_of_segments", "live_speakers", "job_live"])
def test_live_queries_run_in_a_session_with_the_default_state_store(spark, name):
    """A session that names no store, or the one without several states per key."""
    own = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        assert QUERIES[name](spark, SMALL).count() > 0
        assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", own)
