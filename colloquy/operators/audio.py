"""Sound as rows: loudness, pauses and mixing. ``frames(recording_id, frame_no, samples)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, SCALE = 400, 1000
PAUSE_FRAMES = 15
SILENT_DB = -120.0


def samples_of(frames: DataFrame) -> DataFrame:
    """One row per sample, numbered through the recording; frames but the last are equally long."""
    size = frames.groupBy("recording_id").agg(F.max(F.size("samples")).alias("_size"))
    e = frames.join(size, "recording_id").select("recording_id", "frame_no", "_size", F.posexplode("samples").alias("_p", "sample"))
    return e.select("recording_id", (F.col("frame_no") * F.col("_size") + F.col("_p")).alias("sample_no"), F.col("sample").cast("double").alias("sample"))


def loudness(samples: DataFrame, slices: int = SLICES) -> DataFrame:
    """How loud each of ``slices`` equal stretches was, 0 to 1000: ``recording_id, slice_no, level``.

    ``samples(recording_id, sample_no, sample)``. Squares are summed before anything is
    shuffled, so a recording of any length costs its slices.
    """
    n = samples.groupBy("recording_id").agg((F.max("sample_no") + 1).alias("_n"))
    n = n.withColumn("_k", F.least(F.lit(slices).cast("long"), F.col("_n")))
    k = F.floor(((F.col("sample_no") + 1) * F.col("_k") - 1) / F.col("_n"))
    g = samples.join(n, "recording_id").groupBy("recording_id", k.alias("slice_no")).agg(
        F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("_rms"))
    level = F.rint(F.least(F.greatest(F.when(F.isnan("_rms"), 0.0).otherwise(F.col("_rms")), F.lit(0.0)), F.lit(1.0)) * SCALE)
    return g.select("recording_id", "slice_no", level.cast("int").alias("level"))


def missing_loudness(recordings: DataFrame, measured: DataFrame) -> DataFrame:
    """Recordings whose loudness has not been measured yet."""
    return recordings.join(measured.select("recording_id").distinct(), "recording_id", "left_anti")


def energy(frames: DataFrame) -> DataFrame:
    """The mean square of each frame."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return frames.withColumn("energy", total / F.size("samples"))


def rms_db(mean_square: Column) -> Column:
    return F.when(mean_square > 0, 10 * F.log10(mean_square)).otherwise(F.lit(SILENT_DB))


def quietest_cut(frames: DataFrame, low: int = 750, high: int = 1500) -> DataFrame:
    """Where to cut each piece: the middle of its quietest pause between frames ``low`` and ``high``.

    ``frames(recording_id, piece_no, frame_in_piece, energy)``; a piece shorter than ``low``
    is cut at its end. A piece holds at most some ``high`` frames, so it fits a window.
    """
    piece = ["recording_id", "piece_no"]
    w = Window.partitionBy(*piece).orderBy("frame_in_piece")
    half = PAUSE_FRAMES // 2
    part = frames.where((F.col("frame_in_piece") >= low) & (F.col("frame_in_piece") < high))
    smooth = F.round(F.sum("energy").over(w.rowsBetween(-half, half)) / PAUSE_FRAMES, 12)
    best = part.withColumn("_s", smooth).groupBy(*piece).agg(F.min(F.struct("_s", "frame_in_piece")).alias("_b"))
    whole = frames.groupBy(*piece).agg((F.max("frame_in_piece") + 1).alias("_n"))
    return whole.join(best, piece, "left").select(*piece, F.coalesce(F.col("_b.frame_in_piece"), F.least("_n", F.lit(high))).alias("cut_frame"))


def mix_frames(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Two sources of one meeting added sample by sample, as long as the first."""
    other = secondary.select("recording_id", "frame_no", F.col("samples").alias("_o"))
    added = F.transform("samples", lambda x, i: x + F.coalesce(F.get("_o", i), F.lit(0.0)))
    return primary.join(other, ["recording_id", "frame_no"], "left").withColumn("samples", added).drop("_o")
