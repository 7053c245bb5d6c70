"""Removing what a recogniser invents, and what it says twice.

Segments travel with ``ws``, their words with time and original position, so that text,
word timings and the segment's start are always cut together.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import lexicons as lx
from colloquy.functions import text as tx
from colloquy.plans.ordered import in_order
from colloquy.plans.store import materialise

# --- fixed values: what counts as a doubling ---------------------------------
OVERLAP_MIN_WORDS, OVERLAP_MAX_WORDS = 8, 80
OVERLAP_MIN_SHARE, OVERLAP_RUN, OVERLAP_PREFIX = 0.75, 2, 12
REPEAT_MIN_WORDS = 6
CONTAINED_FROM = 40
CREDIT_WORDS = 14

ALL_PHRASES = sorted({p for ps in lx.INVENTED_PHRASES.values() for p in ps})
KEYS = ["recording_id"]


def normalise_text(segments: DataFrame) -> DataFrame:
    """The clean text, the comparison key and the key of each word."""
    return segments.withColumns({
        "text_clean": tx.clean_text(F.col("text")),
        "key": tx.text_key(F.col("text")),
        "word_keys": tx.word_keys(tx.words(F.col("text"))),
    })


def drop_invented_segments(segments: DataFrame, phrases: DataFrame, fillers: bool = True) -> DataFrame:
    """Without the segments that are nothing but an invented phrase, or nothing at all."""
    spoken = segments.where(tx.strip(F.coalesce("text", F.lit(""))) != "")
    if not fillers:
        return spoken
    keyed = spoken.withColumn("key", tx.text_key(F.col("text")))
    return keyed.join(phrases.select("key").distinct(), "key", "left_anti").drop("key")


def with_words(segments: DataFrame) -> DataFrame:
    """Add ``ws``: the reported words, or those of the text without times."""
    def untimed(w, i):
        none = F.lit(None).cast("long")
        return F.struct(w.alias("word"), none.alias("start_ms"), none.alias("end_ms"), i.cast("int").alias("pos"))

    ws = F.transform(tx.words(F.coalesce("text", F.lit(""))), untimed)
    if "words" in segments.columns:
        timed = F.transform("words", lambda w, i: F.struct(
            F.trim(w["word"]).alias("word"), w["start_ms"].alias("start_ms"),
            w["end_ms"].alias("end_ms"), i.cast("int").alias("pos")))
        ws = F.when(F.size("words") > 0, timed).otherwise(ws)
    return segments.withColumn("ws", ws).withColumn("n_before", F.size("ws"))


def _keys(ws: Column) -> Column:
    return F.transform(ws, lambda w: tx.word_key(w["word"]))


def _edge_pattern(phrases: list[str], backwards: bool) -> str:
    """Stacked phrases at the head of space-terminated keys, longest phrase first."""
    order = sorted(phrases, key=lambda p: (-len(p.split()), p))
    alternatives = []
    for p in order:
        ws = p.split()[::-1] if backwards else p.split()
        alternatives.append(" +".join(re.escape(w) for w in ws))
    return "^(?: *(?:" + "|".join(alternatives) + ") +)+"


def edge_words(keys: Column, phrases: list[str], at_end: bool = False) -> Column:
    """How many words at one end of ``keys`` are invented phrases."""
    if not phrases:
        return F.lit(0)
    line = F.concat(F.array_join(F.reverse(keys) if at_end else keys, " "), F.lit(" "))
    hit = F.regexp_extract(line, _edge_pattern(phrases, at_end), 0)
    return F.when(F.size(keys) == 0, 0).otherwise(F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit(""))))


def strip_edge_phrases(segments: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Cut invented phrases glued to either end of ``ws``; ``head_cut`` words went in front."""
    phrases = ALL_PHRASES if phrases is None else phrases
    head = segments.withColumn("head_cut", edge_words(_keys(F.col("ws")), phrases))
    rest = head.withColumn("ws", F.slice("ws", F.col("head_cut") + 1, F.size("ws")))
    tail = edge_words(_keys(F.col("ws")), phrases, at_end=True)
    return rest.withColumn("tail_cut", tail).withColumn(
        "ws", F.slice("ws", F.lit(1), F.greatest(F.size("ws") - F.col("tail_cut"), F.lit(0))))


_RUNS = T.ArrayType(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def _shared_runs(tail, head) -> list[dict]:
    if tail is None or head is None:
        return []
    blocks = SequenceMatcher(None, list(tail), list(head), autojunk=False).get_matching_blocks()
    return [{"b": m.b, "size": m.size} for m in blocks if m.size >= OVERLAP_RUN]


@F.pandas_udf(_RUNS)
def aligned_runs(tail: pd.Series, head: pd.Series) -> pd.Series:
    """The runs of at least two words that two short word lists share, in order."""
    return pd.Series([_shared_runs(a, b) for a, b in zip(tail, head, strict=True)])


@F.pandas_udf(T.ArrayType(_RUNS))
def aligned_runs_each(tails: pd.Series, heads: pd.Series) -> pd.Series:
    """``aligned_runs`` for each place of a segment that needs one."""
    return pd.Series([None if a is None else [_shared_runs(t, h) for t, h in zip(a, b, strict=True)]
                      for a, b in zip(tails, heads, strict=True)])


# Kept where they stand in the plan: a filter on what they cut must not run them again.
aligned_runs = aligned_runs.asNondeterministic()
aligned_runs_each = aligned_runs_each.asNondeterministic()


def _pairs(keys: Column) -> Column:
    return F.zip_with(F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))), F.slice(keys, 2, F.size(keys)),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def last_words(keys: Column) -> Column:
    return F.slice(keys, F.greatest(F.size(keys) - OVERLAP_MAX_WORDS, F.lit(0)) + 1, OVERLAP_MAX_WORDS)


def worth_aligning(tail: Column, head: Column) -> Column:
    """Whether two lists of at most eighty keys share a pair of words in a row.

    Only such rows ever reach Python.
    """
    return ((F.size(tail) >= OVERLAP_MIN_WORDS) & (F.size(head) >= OVERLAP_MIN_WORDS)
            & F.arrays_overlap(_pairs(tail), _pairs(head)))


def cut_from_runs(runs: Column) -> Column:
    """How far into the head the doubling reaches, or 0 where the runs do not prove one."""
    cut = F.array_max(F.transform(runs, lambda r: r["b"] + r["size"]))
    first = F.array_min(F.transform(runs, lambda r: r["b"]))
    matched = F.aggregate(runs, F.lit(0), lambda a, r: a + r["size"])
    proved = (first <= OVERLAP_PREFIX) & (cut >= OVERLAP_MIN_WORDS) & (matched >= OVERLAP_MIN_SHARE * cut)
    return F.coalesce(F.when(proved, cut), F.lit(0))


def with_lookback(segments: DataFrame) -> DataFrame:
    """Add ``recent``: keys of the last eighty words of the two segments before."""
    final = F.slice("ws", F.greatest(F.size("ws") - OVERLAP_MAX_WORDS, F.lit(0)) + 1, OVERLAP_MAX_WORDS)
    own = segments.withColumn("_own", _keys(final))
    two = in_order(own, KEYS, ["seg_no"], lag={"_p1": F.col("_own")}, lag2={"_p2": F.col("_own")})
    none = F.array().cast("array<string>")
    return two.withColumn("recent", F.concat(F.coalesce("_p2", none), F.coalesce("_p1", none))
                          ).drop("_own", "_p1", "_p2")


def trim_overlap(segments: DataFrame) -> DataFrame:
    """Cut the head of a segment that the two before it already said; ``overlap_cut`` words."""
    s = with_lookback(segments).withColumn("_head", _keys(F.slice("ws", 1, OVERLAP_MAX_WORDS)))
    s = s.withColumn("_tail", last_words(F.col("recent"))).withColumn("_worth", worth_aligning(F.col("_tail"), F.col("_head")))
    s = s.withColumn("_runs", aligned_runs(F.when(F.col("_worth"), F.col("_tail")), F.when(F.col("_worth"), F.col("_head"))))
    s = s.withColumn("overlap_cut", cut_from_runs(F.col("_runs")))
    return (s.withColumn("ws", F.slice("ws", F.col("overlap_cut") + 1, F.size("ws")))
            .drop("_tail", "_head", "_worth", "_runs", "recent"))


_CREDIT = r" (?:autore|sottotitoli)(?: [^ ]+){0,%d}? qtss(?= |$)" % (CREDIT_WORDS - 1)


def _credit_line(ws: Column) -> Column:
    marked = F.transform(_keys(ws), lambda k: F.concat(F.lit(" "), F.when(k == "", "~").otherwise(k)))
    return F.array_join(marked, "")


def cut_credits(segments: DataFrame) -> DataFrame:
    """Without the subtitle credit anywhere in ``ws``, nor what follows it said again.

    A segment is split at its credits; each later part loses the words that the parts
    before it, and the two segments before, already said. ``credit_cut`` words went.
    """
    def word_count(p):
        return F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))

    def before(sizes, i):
        return F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)

    s = with_lookback(segments).withColumn("_line", _credit_line(F.col("ws")))
    hit = F.col("_line").rlike(_CREDIT)
    s = s.withColumns({
        "_sizes": F.when(hit, F.transform(F.split("_line", _CREDIT), word_count)),
        "_gaps": F.when(hit, F.transform(F.regexp_extract_all("_line", F.lit(f"({_CREDIT})"), F.lit(1)), word_count))})
    s = s.withColumn("_bits", F.transform("_sizes", lambda n, i: F.slice(
        "ws", before(F.col("_sizes"), i) + before(F.col("_gaps"), i) + 1, n)))
    # What was said before each part, and the part itself, as the alignment wants them.
    def both(said, own):
        return F.when(worth_aligning(said, own), F.struct(said.alias("t"), own.alias("h")))

    sides = F.transform("_bits", lambda b, i: F.when(i > 0, tx.let(
        last_words(F.concat("recent", _keys(F.flatten(F.slice("_bits", F.lit(1), i))))),
        lambda said: tx.let(_keys(F.slice(b, 1, OVERLAP_MAX_WORDS)), lambda own: both(said, own)))))
    s = s.withColumn("_sides", sides)
    s = s.withColumn("_runs", aligned_runs_each(F.transform("_sides", lambda x: x["t"]), F.transform("_sides", lambda x: x["h"])))
    left = F.flatten(F.zip_with("_bits", "_runs", lambda b, r: F.slice(b, cut_from_runs(r) + 1, F.size(b))))
    s = s.withColumn("_left", F.coalesce(left, F.col("ws"))).withColumn("credit_cut", F.size("ws") - F.size("_left"))
    return s.withColumn("ws", F.col("_left")).drop("_sizes", "_gaps", "_bits", "_sides", "_runs", "_left",
                                                   "_line", "recent")


def _kept_positions(keys: list[str]) -> list[int]:
    said = np.array([i for i, k in enumerate(keys) if k], dtype=np.int64)
    codes = np.unique(np.array([keys[i] for i in said], dtype=object).astype(str), return_inverse=True)[1]
    n = len(codes)
    longest = np.zeros(n, dtype=np.int64)
    for size in range(REPEAT_MIN_WORDS, min(OVERLAP_MAX_WORDS, n // 2) + 1):
        same = np.concatenate([[0], np.cumsum(codes[:-size] == codes[size:])])
        whole = np.flatnonzero(same[size:] - same[:-size] == size) + size
        longest[whole] = size
    drop, at = np.zeros(len(keys), dtype=bool), 0
    while at < n:
        if longest[at]:
            stop = at + longest[at]
            drop[said[at]:(said[stop] if stop < n else len(keys))] = True
            at = stop
        else:
            at += 1
    return np.flatnonzero(~drop).tolist()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unrepeated(keys: pd.Series) -> pd.Series:
    """Positions left once every run that immediately repeats the run before it is gone."""
    return pd.Series([None if k is None else _kept_positions(list(k)) for k in keys])


unrepeated = unrepeated.asNondeterministic()


def collapse_repeats(segments: DataFrame) -> DataFrame:
    """Drop a run of 6 to 80 words said again straight away; ``repeat_cut`` words went."""
    worth = tx.let(_keys(F.col("ws")), lambda k: F.when(
        (F.size(k) >= 2 * REPEAT_MIN_WORDS) & (F.size(F.array_distinct(k)) <= F.size(k) - REPEAT_MIN_WORDS), k))
    s = segments.withColumn("_kept", worth).withColumn("_kept", unrepeated("_kept"))
    left = F.when(F.col("_kept").isNull(), F.col("ws")).otherwise(
        F.transform("_kept", lambda i: F.element_at("ws", i + 1)))
    return (s.withColumn("_ws", left).withColumn("repeat_cut", F.size("ws") - F.size("_ws"))
            .withColumn("ws", F.col("_ws")).drop("_kept", "_ws"))


def rebuild(segments: DataFrame) -> DataFrame:
    """Text, times and timed words again from what is left of ``ws``."""
    left = F.size("ws")
    touched = left < F.col("n_before")
    first, final = F.element_at("ws", 1), F.element_at("ws", -1)
    original = tx.words(F.coalesce("text", F.lit("")))
    chars = F.length(F.array_join(original, ""))
    cut = F.length(F.array_join(F.slice(original, F.lit(1), first["pos"]), ""))
    moved = F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * cut / chars).cast("long")
    start = F.when(touched, F.coalesce(first["start_ms"], F.when(first["pos"] > 0, moved), F.col("start_ms"))
                   ).otherwise(F.col("start_ms"))
    end = F.when(touched, F.coalesce(final["end_ms"], F.col("end_ms"))).otherwise(F.col("end_ms"))
    text = F.when(touched, tx.clean_text(F.array_join(F.transform("ws", lambda w: w["word"]), " "))
                  ).otherwise(tx.strip(F.col("text")))
    out = segments.where(left > 0).withColumns({"_text": text, "_start": start, "_end": end})
    if "words" in segments.columns:
        out = out.withColumn("words", F.when(F.col("words").isNull(), F.col("words")).otherwise(
            F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["start_ms"].alias("start_ms"),
                                                 w["end_ms"].alias("end_ms")))))
    return (out.withColumns({"text": F.col("_text"), "start_ms": F.col("_start"), "end_ms": F.col("_end")})
            .drop("_text", "_start", "_end", "ws", "n_before"))


def dedupe_neighbours(segments: DataFrame) -> DataFrame:
    """One segment, the fullest, of each run of neighbours that say the same."""
    s = segments.withColumn("key", tx.text_key(F.col("text")))

    def opens(prev, this):
        a, b = prev["key"], this["key"]
        contained = (F.length(b) > CONTAINED_FROM) & (a != "") & (a.contains(b) | b.contains(a))
        return ~((b != "") & ((a == b) | contained))

    s = in_order(s, KEYS, ["seg_no"], islands=("_island", {"key": F.col("key")}, opens))
    fields = segments.columns
    best = F.max_by(F.struct(*fields), F.struct(F.length("text"), -F.col("seg_no")))
    return s.groupBy("recording_id", "_island").agg(best.alias("b")).select(*[F.col("b")[f].alias(f) for f in fields])


def clean(segments: DataFrame, phrases: DataFrame, fillers: bool = True,
          phrase_list: list[str] | None = None) -> DataFrame:
    """The whole cleaning job: invented speech out, doublings cut, duplicates dropped."""
    s = with_words(drop_invented_segments(segments, phrases, fillers))
    if fillers:
        s = strip_edge_phrases(cut_credits(s), phrase_list).drop("credit_cut", "head_cut", "tail_cut")
        s = materialise(s.where(F.size("ws") > 0))
    s = collapse_repeats(trim_overlap(s)).drop("overlap_cut", "repeat_cut")
    return dedupe_neighbours(materialise(rebuild(s)))
