"""How good a page is: coverage, copying, overlap with a reference, size and speed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import text as tx
from colloquy.operators.terms import TASK_CHARS
from colloquy.plans.store import materialise

MINUTE_MS = 60_000
COVERAGE_FLOOR, COPY_FLOOR, LOST_SHARE = 0.80, 0.30, 0.25
WINDOW = 8
#: Words per piece when shingles of a long text are cut.
PIECE = 4096
EXHAUSTED = 0.98


def coverage(starts: DataFrame, recordings: DataFrame) -> DataFrame:
    """Share of each recording's minutes mentioned: ``recording_id, coverage, low``.

    ``starts(recording_id, start_ms)``, ``recordings(recording_id, duration_ms)``; null where
    the length is unknown.
    """
    length = F.col("duration_ms")
    # One row per minute mentioned before the recordings' lengths are joined.
    minutes = starts.where("start_ms >= 0").groupBy("recording_id", F.floor(F.col("start_ms") / MINUTE_MS).alias("_m")).agg(
        F.min("start_ms").alias("_at"))
    seen = (minutes.join(recordings, "recording_id").where(F.col("_at") < length)
            .groupBy("recording_id").agg(F.count("*").alias("_seen")))
    total = F.greatest(F.lit(1), F.ceil(length / MINUTE_MS))
    share = F.when(length > 0, F.least(F.lit(1.0), F.coalesce("_seen", F.lit(0)) / total))
    return (recordings.join(seen, "recording_id", "left").withColumn("coverage", F.round(share, 6))
            .select("recording_id", "coverage", (F.col("coverage") < COVERAGE_FLOOR).alias("low")))


def lost_on_the_way(reading: DataFrame, page: DataFrame) -> DataFrame:
    """Recordings whose page covers much less than was read."""
    both = reading.select("recording_id", F.col("coverage").alias("read_share")).join(
        page.select("recording_id", F.col("coverage").alias("page_share")), "recording_id")
    return both.withColumn("lost", F.col("read_share") - F.col("page_share") > LOST_SHARE)


def _windows(words: Column, size: int) -> Column:
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1),
                                         lambda i: F.array_join(F.slice(words, i, size), " ")))


def shingles(texts: DataFrame, size: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every run of ``size`` words of each text, accents folded: one row per run.

    A text is cut in pieces that share ``size - 1`` words, so no array grows with its length.
    """
    ws = texts.select("recording_id", *keep, tx.words(tx.fold(F.col("text"))).alias("_w"))
    step = F.sequence(F.lit(0), F.greatest(F.floor((F.size("_w") - size) / PIECE), F.lit(0)))
    pieces = ws.select("recording_id", *keep, F.explode(F.transform(
        step, lambda i: F.slice("_w", (i * PIECE + 1).cast("int"), F.lit(PIECE + size - 1)))).alias("_p"))
    return pieces.select("recording_id", *keep, F.explode(_windows(F.col("_p"), size)).alias("shingle"))


def copy_rate(points: DataFrame, transcripts: DataFrame, size: int = WINDOW, task_chars: int = TASK_CHARS) -> DataFrame:
    """Share of the points' word runs found verbatim in their own transcript.

    Null where the transcript is shorter than a run or the points hold none. Recordings of up to ``task_chars`` characters
    travel once, as texts, and their runs are cut and counted where they arrive; of longer ones the runs travel.
    """
    both = points.select("recording_id", "text", F.lit(True).alias("_point")).unionByName(transcripts.select("recording_id", "text", F.lit(False).alias("_point")))
    source = ~F.col("_point")
    length = materialise(both.groupBy("recording_id").agg(
        F.sum(F.length("text")).alias("_chars"), F.max(source).alias("_source"), (F.max(F.when(source, F.size(tx.words(F.col("text"))))) >= size).alias("_ok")))
    chars, longest = length.agg(F.sum("_chars"), F.max("_chars")).first()

    def counted(texts: DataFrame) -> DataFrame:
        runs = shingles(texts, size, ("_point",)).groupBy("recording_id", "shingle").agg(
            F.count_if("_point").alias("_n"), F.max(source).alias("_found"))
        return runs.where("_n > 0").groupBy("recording_id").agg(
            F.sum("_n").alias("windows"), F.sum(F.when(F.col("_found"), F.col("_n")).otherwise(0)).alias("copied"))

    parts = max(both.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // TASK_CHARS))
    small, all_ = both, None
    if (longest or 0) > task_chars:
        long = length.where(F.col("_chars") > task_chars).select("recording_id")
        small, all_ = both.join(long, "recording_id", "left_anti"), counted(both.join(long, "recording_id", "left_semi"))
    # Grouping by more than the recording keeps this partitioning: the runs are not shuffled.
    own = counted(small.repartition(parts, "recording_id"))
    all_ = own if all_ is None else own.unionByName(all_)
    rate = F.when(F.col("_ok") & (F.col("windows") > 0), F.round(F.col("copied") / F.col("windows"), 6))
    return length.where("_source").select("recording_id", "_ok").join(all_, "recording_id", "left").select(
        "recording_id", "windows", "copied", rate.alias("copy_rate"), (rate > COPY_FLOOR).alias("high"))


def scored_words(text: Column) -> Column:
    """The words overlap is counted on: runs of letters and runs of digits."""
    return F.regexp_extract_all(tx.fold(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+|\p{Nd}+)"), F.lit(1))


def _grams(texts: DataFrame, size: int) -> DataFrame:
    return texts.select("id", F.explode(_windows(scored_words(F.col("text")), size)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def rouge_n(answers: DataFrame, references: DataFrame, size: int) -> DataFrame:
    """ROUGE-n F1 of texts paired by ``id``: overlap of word runs, each counted as often as both have it."""
    h, r = _grams(answers, size), _grams(references, size).withColumnRenamed("n", "m")
    both = h.join(r, ["id", "gram"]).groupBy("id").agg(F.sum(F.least("n", "m")).alias("_both"))
    have = h.groupBy("id").agg(F.sum("n").alias("_h"))
    want = r.groupBy("id").agg(F.sum("m").alias("_r"))
    j = answers.select("id").join(have, "id", "left").join(want, "id", "left").join(both, "id", "left").fillna(0)
    p, q = F.try_divide("_both", "_h"), F.try_divide("_both", "_r")
    f1 = F.when(F.col("_both") > 0, 2 * p * q / (p + q)).otherwise(0.0)
    return j.select("id", F.round(f1, 6).alias(f"rouge_{size}"))


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two word lists.

    A whole row of the table of lengths is one integer, a bit per word of ``b``: clear
    bits mark where the length grows.
    """
    def length(left, right):
        where: dict[str, int] = {}
        for i, word in enumerate(right):
            where[word] = where.get(word, 0) | 1 << i
        full = (1 << len(right)) - 1
        row = full
        for word in left:
            met = row & where.get(word, 0)
            row = ((row + met) | (row - met)) & full
        return len(right) - row.bit_count()
    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(answers: DataFrame, references: DataFrame) -> DataFrame:
    """ROUGE-L F1: the longest common subsequence of the words of texts paired by ``id``."""
    j = answers.select("id", scored_words(F.col("text")).alias("h")).join(
        references.select("id", scored_words(F.col("text")).alias("r")), "id")
    j = j.withColumn("_lcs", common_subsequence("h", "r"))
    p, q = F.try_divide("_lcs", F.size("h")), F.try_divide("_lcs", F.size("r"))
    return j.select("id", F.round(F.when(F.col("_lcs") > 0, 2 * p * q / (p + q)).otherwise(0.0), 6).alias("rouge_l"))


def screening_report(answers: DataFrame) -> DataFrame:
    """Per model: mean scores, how many answers are copied input or empty, seconds per item.

    ``answers(model, id, text, source, seconds, rouge_1, rouge_2)``.
    """
    trimmed = tx.collapse(F.coalesce("text", F.lit("")))
    copied = F.startswith(trimmed, F.substring(tx.collapse(F.col("source")), 1, 60))
    return answers.groupBy("model").agg(
        F.count("*").alias("items"), F.round(F.avg("rouge_1"), 6).alias("rouge_1"), F.round(F.avg("rouge_2"), 6).alias("rouge_2"),
        F.count_if(copied).alias("copied"), F.count_if(trimmed == "").alias("empty"),
        F.round(F.avg("seconds"), 6).alias("seconds"))


def token_totals(texts: DataFrame, language: Column | str | None = None) -> DataFrame:
    """Estimated tokens and characters per recording."""
    return texts.groupBy("recording_id").agg(
        F.sum(tx.estimate_tokens(F.col("text"), language)).alias("tokens"), F.sum(F.length("text").cast("long")).alias("chars"))


def reduction_share(kept: DataFrame, whole: DataFrame, language: Column | str | None = None) -> DataFrame:
    """Per cent of each recording's tokens that a reduced text still has."""
    k = token_totals(kept, language).select("recording_id", F.col("tokens").alias("kept_tokens"))
    w = token_totals(whole, language).select("recording_id", "tokens")
    j = w.join(k, "recording_id", "left").fillna(0, ["kept_tokens"])
    return j.withColumn("kept_share", F.bround(F.try_divide(100.0 * F.col("kept_tokens"), F.col("tokens"))).cast("long"))


def pass_counts(passes: DataFrame, folds: DataFrame) -> DataFrame:
    """What the reading passes and folds of each recording came to.

    ``passes(recording_id, chunk_idx, in_tokens, out_tokens, budget, notes, placed, copied,
    status, span_start_ms, span_end_ms, starts, unknown_headings)``; ``folds(recording_id,
    out_tokens, budget, status, lost)``.
    """
    done = F.col("status").isin("OK", "REUSED") & (F.col("budget") > 0) & (F.col("out_tokens") >= EXHAUSTED * F.col("budget"))
    status = F.when(done, F.lit("BUDGET_EXHAUSTED")).otherwise(F.col("status"))
    said = F.filter("starts", lambda s: s.isNotNull())
    reach = F.least(F.lit(1.0), F.try_divide(F.array_max(said) - F.array_min(said), F.col("span_end_ms") - F.col("span_start_ms")))
    p = passes.withColumns({"_status": status, "_covered": F.when(
        (F.col("span_end_ms") > F.col("span_start_ms")) & (F.size(said) > 0), reach)})
    # Distinct headings first: an array never holds more than the headings a model made up.
    names = (p.select("recording_id", F.explode("unknown_headings").alias("h")).distinct()
             .groupBy("recording_id").agg(F.sort_array(F.collect_list("h")).alias("unknown_headings")))
    a = p.groupBy("recording_id").agg(
        F.count("*").alias("chunks"),
        F.count_if((F.col("notes") == 0) & (F.col("_status") != "NO_CONTENT")).alias("empty_chunks"),
        F.count_if(F.col("_status") == "ECHOED").alias("echoed_chunks"),
        F.count_if(F.col("_status") == "BUDGET_EXHAUSTED").alias("chunks_exhausted"),
        F.sum("notes").alias("notes"), F.sum("placed").alias("notes_placed"), F.sum("copied").alias("notes_copied"),
        F.count_if((F.col("notes") > 0) & (F.col("placed") == 0)).alias("unplaced_chunks"),
        F.max("budget").alias("map_budget"), F.round(F.min("_covered"), 6).alias("least_covered_chunk"))
    f = folds.groupBy("recording_id").agg(
        F.count("*").alias("folds"), F.count_if(F.col("status") == "COLLAPSED").alias("folds_collapsed"),
        F.sum(F.when(F.col("status") == "COLLAPSED", F.col("lost")).otherwise(0)).alias("partials_lost"),
        F.count_if(F.col("status") == "BUDGET_EXHAUSTED").alias("folds_exhausted"))
    return (a.join(f, "recording_id", "left").fillna(0, ["folds", "folds_collapsed", "partials_lost", "folds_exhausted"])
            .join(names, "recording_id", "left")
            .withColumn("unknown_headings", F.coalesce("unknown_headings", F.array().cast("array<string>"))))
