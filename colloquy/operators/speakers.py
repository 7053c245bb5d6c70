"""Who is speaking: interval, as-of and nearest-voice joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import clock
from colloquy.plans.ordered import in_order
from colloquy.plans.store import materialise

KEYS = ["recording_id"]
#: Both sides of an interval join meet in buckets of one minute, so that a recording
#: of any length spreads over the cluster.
BUCKET_MS = 60_000
UNKNOWN_SPEAKER = "SPEAKER_00"
SAME_VOICE = 0.5
LEARN_MS = 600_000


def _buckets(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(clock.div(start, BUCKET_MS), clock.div(F.greatest(end, start), BUCKET_MS)))


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Each segment the turn it overlaps most; else the speaker before it; else the first turn's.

    ``turns`` are ordered by ``turn``; of two overlapping equally the first wins.
    """
    timed = segments.where("start_ms is not null and end_ms is not null").select(
        "recording_id", "seg_no", "start_ms", "end_ms",
        _buckets(F.col("start_ms"), F.col("end_ms")).alias("_b"))
    spans = turns.where("turn_end_ms > turn_start_ms").select(
        "recording_id", "turn", "turn_start_ms", "turn_end_ms", F.col("speaker").alias("_who"),
        _buckets(F.col("turn_start_ms"), F.col("turn_end_ms")).alias("_b"))
    overlap = F.least("end_ms", "turn_end_ms") - F.greatest("start_ms", "turn_start_ms")
    # A pair met in several buckets is the same candidate each time: max ignores repeats.
    best = (timed.join(spans, ["recording_id", "_b"])
            .where((F.col("start_ms") < F.col("turn_end_ms")) & (F.col("end_ms") > F.col("turn_start_ms")))
            .groupBy("recording_id", "seg_no")
            .agg(F.max_by("_who", F.struct(overlap, -F.col("turn"))).alias("_best")))
    opening = turns.groupBy("recording_id").agg(F.min_by("speaker", "turn").alias("_opening"))
    s = segments.drop("speaker").join(best, ["recording_id", "seg_no"], "left")
    s = in_order(s, KEYS, ["seg_no"], last={"_held": F.col("_best")})
    return (s.join(opening, "recording_id", "left")
            .withColumn("speaker", F.coalesce("_held", "_opening", F.lit(UNKNOWN_SPEAKER)))
            .drop("_best", "_held", "_opening"))


def rename_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Labels replaced by the names given; blank names ignored, ``label`` keeps the origin."""
    wanted = names.select("recording_id", F.col("speaker").alias("label"), F.trim("name").alias("_name")).where("_name <> ''")
    s = segments.withColumnRenamed("speaker", "label").join(wanted, ["recording_id", "label"], "left")
    return s.withColumn("speaker", F.coalesce("_name", "label")).drop("_name")


def restore_clock(times: DataFrame, speech: DataFrame) -> DataFrame:
    """Times measured without the silences, put back on the recording's own clock.

    ``times(recording_id, id, at_ms)``; ``speech(recording_id, part_no, start_ms, end_ms)``.
    A time belongs to the first part whose cumulative end reaches it. Both sides meet in
    minute buckets of the trimmed clock, and times past the end take the last part.
    """
    p = in_order(speech.withColumn("_len", F.col("end_ms") - F.col("start_ms")), KEYS, ["part_no"],
                 sums={"_upto": F.col("_len")})
    p = p.select("recording_id", "_upto", (F.col("_upto") - F.col("_len")).alias("_from"),
                 (F.col("start_ms") - (F.col("_upto") - F.col("_len"))).alias("_shift"), "part_no")
    final = p.groupBy("recording_id").agg(F.max_by("_shift", "part_no").alias("_last"),
                                          F.max("_upto").alias("_end"),
                                          F.min_by("_shift", "part_no").alias("_first"))
    spread = p.where("_upto > _from").select("*", _buckets(F.col("_from"), F.col("_upto")).alias("_b"))
    t = times.withColumn("_b", clock.div(F.col("at_ms"), BUCKET_MS))
    hit = (t.join(spread, ["recording_id", "_b"])
           .where((F.col("at_ms") > F.col("_from")) & (F.col("at_ms") <= F.col("_upto")))
           .select("recording_id", "id", "_shift"))
    out = times.join(hit, ["recording_id", "id"], "left").join(final, "recording_id", "left")
    shift = F.when(F.col("at_ms") > F.col("_end"), F.col("_last")).otherwise(F.coalesce("_shift", "_first"))
    return out.select("recording_id", "id", "at_ms", (F.col("at_ms") + shift).alias("real_ms"))


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """Scaled to length one; null where that cannot be done."""
    v = v.cast("array<double>")
    n = _norm(v)
    usable = (n > 0) & ~F.isnan(n) & (n != float("inf"))
    return F.when(usable, F.transform(v, lambda x: x / n))


def learn_voices(stretches: DataFrame) -> DataFrame:
    """Per speaker the sum of the unit vectors heard: ``recording_id, speaker, sum_vec, n``."""
    v = stretches.withColumn("_u", unit(F.col("vector"))).where("_u is not null")
    dims = (v.select("recording_id", "speaker", F.posexplode("_u").alias("_d", "_x"))
            .groupBy("recording_id", "speaker", "_d").agg(F.sum("_x").alias("_x"), F.count("*").alias("n")))
    # One row per dimension: the array has the vector's own fixed length.
    return dims.groupBy("recording_id", "speaker").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_d", "_x"))), lambda d: d["_x"]).alias("sum_vec"),
        F.max("n").alias("n"))


#: New voices looked for at once in each recording; more than these take another round.
LEADERS = 64


def _cosine() -> Column:
    return F.aggregate(F.zip_with("_u", "_c", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)


def _leader_schema(left: DataFrame) -> T.StructType:
    return T.StructType([left.schema["recording_id"], T.StructField("_lead", T.IntegerType()),
                         T.StructField("_c", T.ArrayType(T.DoubleType()))])


def _pick_leaders(same: float):
    """Of a recording's earliest stretches, those unlike every one picked before them."""
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf.sort_values("seg_no")["_u"].to_list())
        alike, leaders = vectors @ vectors.T, [0]
        for i in range(1, len(vectors)):
            if alike[i, leaders].max() < same:
                leaders.append(i)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "_lead": range(len(leaders)),
                             "_c": [vectors[i].tolist() for i in leaders]})
    return pick


def _nearest(stretches: DataFrame, known: DataFrame) -> DataFrame:
    """Per stretch the known voice of the highest cosine: ``recording_id, seg_no, _best(d, w)``."""
    return (stretches.join(known, "recording_id").groupBy("recording_id", "seg_no")
            .agg(F.max(F.struct(_cosine().alias("d"), F.col("_who").alias("w"))).alias("_best")))


def match_voices(stretches: DataFrame, voices: DataFrame, fixed: bool = False,
                 same: float = SAME_VOICE) -> DataFrame:
    """Each stretch the voice it sounds most like; unlike all of them, a new voice.

    Learned voices stay as they were learned. Stretches unlike all of them are settled in
    rounds: the earliest left in each recording that are unlike one another become the next
    ``SPEAKER_nn``, and each takes, in that order, those that sound like it. A stretch without a vector keeps the speaker before
    it. ``likeness`` is the cosine to the voice given.
    """
    known = voices.select("recording_id", F.col("speaker").alias("_who"), unit(F.col("sum_vec")).alias("_c"))
    s = stretches.select("recording_id", "seg_no", unit(F.col("vector")).alias("_u"))
    heard = s.where("_u is not null")
    best = heard.join(_nearest(heard, known), ["recording_id", "seg_no"], "left")
    given = best.select("recording_id", "seg_no", F.col("_best.w").alias("_own"), F.col("_best.d").alias("likeness"))
    if not fixed:
        strange = F.coalesce(F.col("_best.d"), F.lit(-1.0)) < same
        best = materialise(best.withColumn("_strange", strange))
        given = best.where("not _strange").select("recording_id", "seg_no", F.col("_best.w").alias("_own"),
                                                  F.col("_best.d").alias("likeness"))
        left = best.where("_strange").select("recording_id", "seg_no", "_u")
        # New labels are the numbers from the count of learned voices on that no voice has.
        number = F.regexp_extract("speaker", r"^SPEAKER_(\d+)$", 1).try_cast("int")
        taken = voices.groupBy("recording_id").agg(F.count("*").cast("int").alias("_base"), F.collect_set(number).alias("_used")).withColumn("_n", F.lit(0))
        while not left.isEmpty():
            nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("seg_no"))
            leaders = materialise(left.withColumn("_r", nth).where(F.col("_r") <= LEADERS)
                                  .groupBy("recording_id").applyInPandas(_pick_leaders(same), _leader_schema(left)))
            nth = F.coalesce("_n", F.lit(0)) + F.col("_lead")
            used, base = F.coalesce("_used", F.array().cast("array<int>")), F.coalesce("_base", F.lit(0))
            free = F.filter(F.sequence(base, base + nth + F.size(used)), lambda x: ~F.array_contains(used, x))
            label = F.get(free, nth).cast("string")
            named = leaders.join(taken, "recording_id", "left").select("recording_id", "_lead", "_c", F.concat(
                F.lit("SPEAKER_"), F.when(F.length(label) < 2, F.lpad(label, 2, "0")).otherwise(label)).alias("_who"))
            met = left.join(named, "recording_id").withColumn("_d", _cosine()).where(F.col("_d") >= same)
            first = materialise(met.groupBy("recording_id", "seg_no").agg(
                F.min_by(F.struct("_who", "_d"), "_lead").alias("_f")))
            given = given.unionByName(first.select("recording_id", "seg_no", F.col("_f._who").alias("_own"),
                                                   F.col("_f._d").alias("likeness")))
            left = materialise(left.join(first, ["recording_id", "seg_no"], "left_anti"))
            more = leaders.groupBy("recording_id").agg(F.count("*").cast("int").alias("_m"))
            taken = materialise(taken.join(more, "recording_id", "full").select(
                "recording_id", "_base", "_used", (F.coalesce("_n", F.lit(0)) + F.coalesce("_m", F.lit(0))).alias("_n")))
    m = s.select("recording_id", "seg_no").join(given, ["recording_id", "seg_no"], "left")
    m = in_order(m, KEYS, ["seg_no"], last={"speaker": F.col("_own")})
    return m.select("recording_id", "seg_no", "speaker", "likeness")


def speakers_in_order(segments: DataFrame) -> DataFrame:
    """Who speaks, by first appearance: ``recording_id, ord, speaker, first_seg``."""
    first = (segments.where("coalesce(speaker, '') <> ''").groupBy("recording_id", "speaker")
             .agg(F.min("seg_no").alias("first_seg")))
    ord_ = F.row_number().over(Window.partitionBy("recording_id").orderBy("first_seg"))
    return first.withColumn("ord", ord_.cast("long"))


def first_lines(segments: DataFrame) -> DataFrame:
    """The first thing each speaker says."""
    said = segments.where("coalesce(speaker, '') <> '' and trim(coalesce(text, '')) <> ''")
    return said.groupBy("recording_id", "speaker").agg(F.min_by("text", "seg_no").alias("line"))


def early_and_late(early: DataFrame, late: DataFrame, learn_ms: int = LEARN_MS) -> DataFrame:
    """Segments assigned from turns up to the boundary, matched by voice after it."""
    return (early.where(F.coalesce("start_ms", F.lit(0)) < learn_ms)
            .unionByName(late.where(F.coalesce("start_ms", F.lit(0)) >= learn_ms)))


def recording_stats(segments: DataFrame) -> DataFrame:
    """Words, segments, length and speakers of each recording."""
    from colloquy.functions.text import words
    return segments.groupBy("recording_id").agg(
        F.sum(F.size(words(F.coalesce("text", F.lit("")))).cast("long")).alias("words"), F.count("*").alias("segments"),
        F.max("end_ms").alias("duration_ms"), F.count_distinct("speaker").alias("speakers"))
