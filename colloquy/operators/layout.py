"""Words to segments, segments to paragraphs, dialogue and blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import clock
from colloquy.functions import text as tx
from colloquy.operators import terms as tm
from colloquy.plans.folds import fold_blocks
from colloquy.plans.ordered import dense, in_order
from colloquy.plans.store import materialise

KEYS = ["recording_id"]
SENTENCE_END = r"[.!?…]+[\"'”»)\]]*$"
#: Rows of one island joined into one string; a longer island continues in the next part.
PART_ROWS = 4096


def _texts(col: str, order: list[str]):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, col))), lambda x: x[col]), " ")


def close_open_ends(segments: DataFrame, recordings: DataFrame) -> DataFrame:
    """Give a segment without an end the next start, or the recording's length."""
    s = in_order(segments, KEYS, ["seg_no"], lead={"_next": F.col("start_ms")})
    s = s.where((tx.strip(F.coalesce("text", F.lit(""))) != "") & F.col("start_ms").isNotNull())
    s = s.join(recordings.select("recording_id", F.col("duration_ms").alias("_length")), "recording_id", "left")
    return (s.withColumn("end_ms", F.coalesce("end_ms", "_next", "_length"))
            .where("end_ms is not null").drop("_next", "_length"))


def _opens_segment(pause_ms: int, max_ms: int, max_chars: int):
    """Mark the words that open a new segment. State: first start, last end, width, open."""
    def fold(pdf: pd.DataFrame, state: list[float]):
        nan, marks = float("nan"), []
        # A missing time crosses a block's edge as -1.
        opened, last = (nan if x < 0 else x for x in state[:2])
        width, is_open = state[2:]
        for word_len, start, end, stop in zip(pdf["_len"], pdf["start_ms"].astype(float),
                                              pdf["end_ms"].astype(float), pdf["_stop"], strict=True):
            fresh = not is_open
            if is_open:
                gap = start - last                      # not a number where a time is missing
                reach = end if end == end else (start if start == start else 0.0)
                fresh = gap > pause_ms or reach - opened > max_ms or width >= max_chars
            marks.append(fresh)
            if fresh:
                opened, width = start, 0.0
            last, width, is_open = end, width + word_len + 1, 0.0 if stop else 1.0
        if not is_open:
            opened, last, width = -1.0, -1.0, 0.0
        guard = [-1.0 if x != x else x for x in (opened, last)]
        return {"opens": np.array(marks, dtype=bool)}, [*guard, width, is_open]
    return fold


def segments_from_words(words: DataFrame, pause_ms: int = 600, max_ms: int = 20_000,
                        max_chars: int = 400) -> DataFrame:
    """Timed words grouped at sentence ends, pauses, and where a segment has grown long."""
    w = words.where(F.trim("word") != "").withColumn("word", F.trim("word"))
    w = dense(w, KEYS, ["seg_no", "word_no"], "_n").withColumns({
        "_len": F.length("word"), "_stop": F.col("word").rlike(SENTENCE_END)})
    w = w.select("recording_id", "_n", "word", "start_ms", "end_ms", "_len", "_stop")
    out = T.StructType([w.schema["recording_id"], T.StructField("_n", T.LongType()),
                        T.StructField("word", T.StringType()), T.StructField("start_ms", T.LongType()),
                        T.StructField("end_ms", T.LongType()), T.StructField("opens", T.BooleanType())])
    marked = materialise(fold_blocks(w, KEYS, "_n", _opens_segment(pause_ms, max_ms, max_chars), out, [-1.0, -1.0, 0.0, 0.0], reads=["_len", "start_ms", "end_ms", "_stop"]))
    g = in_order(marked, KEYS, ["_n"], sums={"_seg": F.col("opens").cast("int")})
    row = F.struct("_n", "word", "start_ms", "end_ms")
    g = g.groupBy("recording_id", (F.col("_seg") - 1).alias("seg_no")).agg(
        F.sort_array(F.collect_list(row)).alias("_w"),
        F.min_by("start_ms", F.when(F.col("start_ms").isNotNull(), F.col("_n"))).alias("_s"),
        F.max_by("start_ms", F.when(F.col("start_ms").isNotNull(), F.col("_n"))).alias("_ls"),
        F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), F.col("_n"))).alias("_e"))
    return g.select("recording_id", "seg_no",
                    tx.clean_text(F.array_join(F.transform("_w", lambda x: x["word"]), " ")).alias("text"),
                    F.coalesce("_s", F.lit(0)).alias("start_ms"),
                    F.coalesce("_e", "_ls", F.lit(0)).alias("end_ms"),
                    F.transform("_w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"),
                                                         x["end_ms"].alias("end_ms"))).alias("words"))


def paragraphs(segments: DataFrame, gap_ms: int = 1200, max_chars: int = 600) -> DataFrame:
    """Segments joined until a pause, a missing time, or a full paragraph."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    s = segments.select("recording_id", "seg_no", text.alias("text"), "start_ms", "end_ms")
    s = in_order(s, KEYS, ["seg_no"], lead={"_next": F.col("start_ms")},
                 sums={"_n": (F.col("text") != "").cast("int")})
    gap = F.col("_next") - F.col("end_ms")
    s = s.where("text <> ''").withColumns({"_break": gap.isNull() | (gap > gap_ms), "_len": F.length("text"),
                                           "_n": (F.col("_n") - 1).cast("long")}).drop("_next")
    out = T.StructType([s.schema[c] for c in ("recording_id", "_n", "text", "start_ms", "end_ms")]
                       + [T.StructField("opens", T.BooleanType())])

    def fold(pdf, state):
        width, opens = state[0], []
        for n, stop in zip(pdf["_len"], pdf["_break"], strict=True):
            opens.append(width == 0)
            width = width + n + (1 if width else 0)
            if stop or width >= max_chars:
                width = 0
        return {"opens": np.array(opens, dtype=bool)}, [width]

    marked = materialise(fold_blocks(s, KEYS, "_n", fold, out, [0.0], reads=["_len", "_break"]))
    g = in_order(marked, KEYS, ["_n"], sums={"_p": F.col("opens").cast("int")})
    return g.groupBy("recording_id", (F.col("_p") - 1).alias("para_no")).agg(
        tx.clean_text(_texts("text", ["_n"])).alias("text"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def paragraphs_from_prose(sentences: DataFrame, per: int = 5) -> DataFrame:
    """Sentences without times, five to a paragraph. ``sent_no`` is dense."""
    return sentences.groupBy("recording_id", F.floor(F.col("sent_no") / per).alias("para_no")).agg(
        _texts("text", ["sent_no"]).alias("text"))


def paragraphs_of_prose(prose: DataFrame, per: int = 5) -> DataFrame:
    """As :func:`paragraphs_from_prose` of the sentences of ``prose(recording_id, text)``, one row a recording: no sentence leaves its row."""
    sentences = tm.sentence_array(F.coalesce("text", F.lit("")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / per).cast("int")), lambda i: F.array_join(F.slice("_s", i * per + 1, F.lit(per)), " "))
    p = prose.select("recording_id", sentences.alias("_s")).select("recording_id", F.posexplode(F.when(F.size("_s") > 0, runs)).alias("para_no", "text"))
    return p.withColumn("para_no", F.col("para_no").cast("long"))


def untimed(prose: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of ``prose`` whose recording has no segments. Their numbers are written first: known to be few, they meet the texts without moving them."""
    timed = materialise(segments.select("recording_id").distinct())
    return prose.join(timed, "recording_id", "left_anti")


def paragraphs_of_text(prose: DataFrame, per: int = 5) -> DataFrame:
    """Texts without times: cut after every mark that ends a sentence (abbreviations too), ``per`` sentences a paragraph.

    ``prose(recording_id, text)``; a text without words has no paragraph.
    """
    ends = F.split(F.regexp_replace(tx.clean_text(F.coalesce("text", F.lit(""))), r"([.!?…])\s+", "$1\x1f"), "\x1f")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / per).cast("int")),
                       lambda i: F.trim(F.array_join(F.slice("_s", i * per + 1, F.lit(per)), " ")))
    p = prose.select("recording_id", ends.alias("_s")).select("recording_id", F.posexplode(runs).alias("para_no", "text"))
    return p.where("text <> ''").withColumn("para_no", F.col("para_no").cast("long"))


def dialogue(segments: DataFrame) -> DataFrame:
    """Consecutive segments of one speaker as one turn: ``[speaker] text``, a row per turn of any length.

    Texts are joined in pieces of ``PART_ROWS`` segments first, so that a long turn is spread over tasks until
    its last step. ``part`` is always 0. A turn's text has to fit a row, as does the text of its SQL.
    """
    s = in_order(segments, KEYS, ["seg_no"], islands=(
        "turn_no", {"s": F.col("speaker")}, lambda a, b: ~a["s"].eqNullSafe(b["s"])))
    pieces = s.groupBy("recording_id", "turn_no", F.floor(F.col("seg_no") / PART_ROWS).alias("_piece")).agg(
        F.first("speaker").alias("speaker"), _texts("text", ["seg_no"]).alias("text"))
    g = pieces.groupBy("recording_id", "turn_no").agg(
        F.first("speaker").alias("speaker"), tx.clean_text(_texts("text", ["_piece"])).alias("_t"))
    return g.where("_t <> ''").select("recording_id", "turn_no", F.lit(0).cast("long").alias("part"), "speaker",
                                      F.concat(F.lit("["), "speaker", F.lit("] "), "_t").alias("text"))


def prompt_text(sentences: DataFrame, order: str = "seg_no", keys: list[str] | None = None) -> DataFrame:
    """``[m:ss] Speaker: text`` a line, the speaker only where it changes."""
    keys = keys or KEYS
    s = in_order(sentences, keys, [order], before={"_before": F.col("speaker")})
    named = F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.col("_before"))
    line = F.concat_ws(" ", F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("["), clock.format_clock(F.col("start_ms")), F.lit("]"))),
                       F.when(named, F.concat("speaker", F.lit(":"))), F.col("text"))
    return s.select(*keys, order, line.alias("line"))


def transcript_blocks(segments: DataFrame, prose_paragraphs: DataFrame) -> DataFrame:
    """(start, clock, body) per timed segment; paragraphs without time for the other recordings."""
    body = tx.strip(F.coalesce("text", F.lit("")))
    timed = segments.where(body != "").select(
        "recording_id", F.col("seg_no").alias("block_no"), "start_ms",
        F.when(F.col("start_ms").isNotNull(), clock.format_clock(F.col("start_ms"))).otherwise(F.lit("")).alias("clock"),
        F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "), body)).otherwise(body).alias("body"))
    rest = untimed(prose_paragraphs, segments).select(
        "recording_id", F.col("para_no").alias("block_no"), F.lit(None).cast("long").alias("start_ms"),
        F.lit("").alias("clock"), F.col("text").alias("body"))
    return timed.unionByName(rest)


def timed_or_prose(segments: DataFrame, prose: DataFrame) -> DataFrame:
    """Each recording once: its segments where it has any, its text otherwise."""
    timed = segments.select("recording_id", "seg_no", "text", "start_ms", "end_ms", "speaker")
    none = F.lit(None)
    rest = untimed(prose, segments).select(
        "recording_id", F.lit(0).cast("long").alias("seg_no"), "text", none.cast("long").alias("start_ms"),
        none.cast("long").alias("end_ms"), none.cast("string").alias("speaker"))
    return timed.unionByName(rest)
