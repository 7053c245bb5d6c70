"""Tables as files. Every writer keeps one task to a bounded stretch of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.sources.readers import PART_SEGMENTS

#: Lines of one output file.
FILE_ROWS = 65_536


def ordered_text(rows: DataFrame, order: str, text: str, path: str) -> None:
    """Text files per recording, in ``order``; a long recording continues in further files.

    The file of a row is fixed by its place, so names sort as the text reads.
    """
    part = F.lpad(F.floor(F.col(order) / FILE_ROWS).cast("string"), 8, "0")
    placed = rows.select("recording_id", part.alias("part"), order, F.col(text).alias("value"))
    (placed.repartition("recording_id", "part").sortWithinPartitions("recording_id", "part", order)
     .drop(order).write.mode("error").partitionBy("recording_id", "part").text(path))


def write_transcripts(blocks: DataFrame, path: str) -> None:
    """One readable text per recording, from paragraphs or turns numbered ``block_no``."""
    spaced = blocks.withColumn("_t", F.concat(F.when(F.col("block_no") > 0, "\n").otherwise(""), "text"))
    ordered_text(spaced, "block_no", "_t", path)


def segments_json(segments: DataFrame) -> DataFrame:
    """The stored form, ``recording_id, part, value``: at most ``PART_SEGMENTS`` segments a part."""
    timed = "words" in segments.columns

    def seconds(c):
        return c / 1000

    fields = [F.col("text"), seconds(F.col("start_ms")).alias("start"), seconds(F.col("end_ms")).alias("end"), F.col("speaker")]
    if timed:
        fields.append(F.transform("words", lambda w: F.struct(w["word"].alias("word"), seconds(w["start_ms"]).alias("start"),
                                                              seconds(w["end_ms"]).alias("end"))).alias("words"))
    s = segments.withColumn("_s", F.struct(*fields))
    part = F.floor(F.col("seg_no") / PART_SEGMENTS).cast("int")
    return s.groupBy("recording_id", part.alias("part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "_s"))), lambda x: x["_s"]).alias("segments")).select(
        "recording_id", "part", F.to_json(F.struct(F.lit(1).alias("schema"), "segments")).alias("value"))


def write_segments_json(segments: DataFrame, path: str) -> None:
    segments_json(segments).write.mode("error").partitionBy("recording_id", "part").text(path)


def write_subtitles(exported: DataFrame, path: str) -> None:
    """The rows of ``subtitles.export_subtitles`` as files, in cue order."""
    ordered_text(exported, "cue_no", "block", path)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.select("recording_id", F.col("page").alias("value")).write.mode("error").partitionBy("recording_id").text(path)


def append_summaries(summaries: DataFrame, path: str) -> None:
    """A new version of each summary; ``catalogue.current_summaries`` tells which one counts."""
    summaries.write.mode("append").parquet(path)
