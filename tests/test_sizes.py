"""Results that must not depend on how much there is."""

import struct

import pytest
from pyspark.sql import functions as F

from colloquy.functions import lexicons as lx
from colloquy.operators import catalogue, layout, notes, speakers
from colloquy.plans import store
from colloquy.sources import readers


def wav(before=0, odd=False, seconds=3, rate=8000):
    """A PCM WAV whose sound comes after ``before`` other chunks, one of them holding the word data."""
    other = b"".join(b"LIST" + struct.pack("<I", 7 if odd else 8) + b"xxdataxx"[:7 if odd else 8] + (b"\0" if odd else b"") for _ in range(before))
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + other + fmt + b"data" + struct.pack("<I", seconds * rate * 2) + b"\0" * 40


@pytest.mark.parametrize("before, odd", [(0, False), (3, True), (31, False), (600, True)])
def test_wav_length_wherever_the_sound_starts(spark, before, odd):
    rows = spark.createDataFrame([(bytearray(wav(before, odd)),), (bytearray(b"RIFF0000WAVE"),), (bytearray(b"no"),), (None,)], "content binary")
    assert [r[0] for r in rows.select(readers.wav_seconds(F.col("content"))).collect()] == [3, None, None, None]


def test_more_than_a_hundred_voices(spark):
    n = 130
    vector = lambda i: [1.0 if j == i else 0.0 for j in range(n)]
    stretches = spark.createDataFrame([(1, i, vector(i)) for i in range(n)], "recording_id long, seg_no long, vector array<double>")
    learned = spark.createDataFrame([(1, "SPEAKER_01", vector(0), 1), (1, "SPEAKER_05", vector(1), 1)], "recording_id long, speaker string, sum_vec array<double>, n long")
    got = {r["seg_no"]: r["speaker"] for r in speakers.match_voices(stretches, learned).collect()}
    free = [k for k in range(2, 200) if k != 5]
    assert got == {0: "SPEAKER_01", 1: "SPEAKER_05"} | {i: f"SPEAKER_{free[i - 2]:02d}" for i in range(2, n)}


@pytest.mark.parametrize("n", [4096, 4097, 20000])
def test_a_turn_of_any_length_is_a_row(spark, n):
    segments = spark.range(n + 1).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("seg_no"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"),
                                         F.when(F.col("id") < n, "A").otherwise("B").alias("speaker"))
    got = [tuple(r) for r in layout.dialogue(segments).orderBy("turn_no").select("turn_no", "part", "speaker", "text").collect()]
    assert got == [(0, 0, "A", "[A] " + " ".join(f"w{i}" for i in range(n))), (1, 0, "B", f"[B] w{n}")]


@pytest.mark.parametrize("block_rows", [1, 7, 8, 16384])
def test_untimed_words_at_block_edges(spark, block_rows, monkeypatch):
    words = spark.createDataFrame([(1, 0, i, f"w{i}", None if i % 8 == 7 else i * 300, None if i % 8 == 7 else i * 300 + 200) for i in range(40)],
                                  "recording_id long, seg_no long, word_no long, word string, start_ms long, end_ms long")
    plain = layout.fold_blocks
    monkeypatch.setattr(layout, "fold_blocks", lambda *a, **b: plain(*a, **b, block_rows=block_rows))
    assert [len(r["words"]) for r in layout.segments_from_words(words).orderBy("seg_no").collect()] == [40]


def test_look_ups_in_blocks(spark, monkeypatch):
    entries = spark.createDataFrame([(f"e{i}", f"name{i}", f"Title {i}", f"text {i}.") for i in range(12)], "entry_id string, name string, title string, text string")
    queries = spark.createDataFrame([(f"title {i}",) for i in range(11)] + [("e3",), ("text 5.",), ("",)], "query string")
    one = [sorted(map(str, f(entries, queries).collect())) for f in (catalogue.search_library, catalogue.find_entries)]
    monkeypatch.setattr(catalogue, "QUERY_BLOCK", 3)
    assert one == [sorted(map(str, f(entries, queries).collect())) for f in (catalogue.search_library, catalogue.find_entries)]


def test_headings_in_blocks(spark, monkeypatch):
    headings = spark.createDataFrame([(h,) for h in ("Decisioni", "Decisione", "Actions", "Azzioni", "zzz", "Open questions")], "heading string")
    one = sorted(map(str, notes.route_headings(headings, lx.kinds(spark)).collect()))
    monkeypatch.setattr(notes, "KIND_BLOCK", 2)
    assert one == sorted(map(str, notes.route_headings(headings, lx.kinds(spark)).collect()))


def test_a_cluster_has_to_name_its_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})
    with pytest.raises(ValueError):
        store.shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://x/shared/"
    assert store.shared_dir(Session()) == "hdfs://x/shared"
