"""Sentences, content words and their weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions import lexicons as lx
from colloquy.functions import text as tx
from colloquy.plans.ordered import dense
from colloquy.plans.store import materialise
from colloquy.plans.tasks import in_place

KEYS = ["recording_id"]
#: Characters of text that one task counts the words of; longer recordings are counted by many.
TASK_CHARS = 4 << 20
#: Characters, or weighted words, of a recording whose sentences are compared in a task, and numbers that are held there at once.
COMPARED_CHARS, COMPARED_WORDS, CELLS = 1 << 20, 150_000, 1 << 22


def sentence_array(text: Column) -> Column:
    """Split after a full stop and a space, except after an abbreviation.

    A piece whose last word is an abbreviation (an elided article before it or not) is
    glued to the next by marking the boundary instead of splitting there.
    """
    flat = tx.collapse(text)
    known = "|".join(a.replace(".", r"\.") for a in sorted(lx.ABBREVIATIONS, key=lambda a: (-len(a), a)))
    # The space and the stop come first: looking back for an abbreviation is dear, and few places need it.
    after_stop = r" (?<=[.!?…] )"
    not_abbreviated = rf"(?<!(?i)(?:^|[ ']|\x1f)(?:{known})[.!?…]{{1,9}} )"
    return F.filter(F.split(flat, after_stop + not_abbreviated), lambda s: s != "")


def split_sentences(texts: DataFrame, order: str | None = None) -> DataFrame:
    """``recording_id, sent_no, text`` (+ times and speaker of the segment it came from)."""
    kept = [c for c in ("language", "start_ms", "end_ms", "speaker") if c in texts.columns]
    pieces = texts.select("recording_id", *([order] if order else []), *kept,
                          F.posexplode(sentence_array(F.coalesce("text", F.lit("")))).alias("_pos", "text"))
    if order is None:
        return pieces.withColumn("sent_no", F.col("_pos").cast("long")).drop("_pos")
    return dense(pieces, KEYS, [order, "_pos"], "sent_no").drop(order, "_pos")


def stop_words(spark: SparkSession) -> DataFrame:
    rows = [(lang, w) for lang, ws in lx.STOP_WORDS.items() for w in ws]
    return spark.createDataFrame(rows, "_lang string, _folded string")


def content_terms(sentences: DataFrame, language: Column | str | None = None, ids: tuple[str, ...] = ("sent_no",), every: bool = False) -> DataFrame:
    """One row per content word: stop words gone, elided articles cut off; with ``every``, one with an empty word per sentence besides."""
    lang = tx.language_of(language) if language is not None else F.lit("en")
    e = sentences.select("recording_id", *ids, lang.alias("_lang"), F.explode(
        F.concat(F.coalesce(tx.terms(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(""))) if every else tx.terms(F.col("text"))).alias("term"))
    stops = F.broadcast(stop_words(sentences.sparkSession))    # a fixed list of a few hundred words
    return (e.withColumn("_folded", tx.fold(F.col("term"))).join(stops, ["_lang", "_folded"], "left_anti")
            .select("recording_id", *ids, "term"))


def term_counts(sentences: DataFrame, language: Column | str | None = None, ids: tuple[str, ...] = ("sent_no",), every: bool = False) -> DataFrame:
    return content_terms(sentences, language, ids, every).groupBy("recording_id", *ids, "term").agg(F.count("*").alias("tf"))


def weights(sentences: DataFrame, language: Column | str | None = None, ids: tuple[str, ...] = ("sent_no",), task_chars: int | None = None,
            every: bool = False) -> DataFrame:
    """Tf-idf of every content word, each sentence's vector of length one; with ``every``, a row with an empty word per sentence besides, of weight 0.

    ``recording_id, *ids, term, tf, df, w``: sparse, one row per word of a sentence.

    Recordings of up to ``task_chars`` characters travel once, as sentences, and are counted where they arrive; of longer ones
    the words travel, so that no task holds one whole.
    """
    limit = TASK_CHARS if task_chars is None else task_chars
    size = materialise(sentences.groupBy("recording_id").agg(F.count("*").alias("_n"), F.sum(F.length("text")).alias("_chars")))
    chars, longest = size.agg(F.sum("_chars"), F.max("_chars")).first()
    here = ["recording_id", *ids]

    def weighed(t: DataFrame) -> DataFrame:
        raw = F.col("tf") * (F.log((1.0 + F.col("_n")) / (1.0 + F.col("df"))) + 1.0)
        if every:
            raw = F.when(F.col("term") == "", 0.0).otherwise(raw)
        norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*here)))
        w = F.when(F.col("_raw") == 0, 0.0).otherwise(F.col("_raw") / norm) if every else F.col("_raw") / norm
        return t.withColumn("_raw", raw).withColumn("w", w).select(*here, "term", "tf", "df", "w")

    fits = size.where(F.coalesce("_chars", F.lit(0)) <= limit)
    # Grouping and windows on more than the recording keep this partitioning: the words are not shuffled.
    parts = max(sentences.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // TASK_CHARS))
    own = sentences.join(fits.select("recording_id"), "recording_id", "left_semi") if (longest or 0) > limit else sentences
    tf = term_counts(own.repartition(parts, "recording_id"), language, ids, every)
    tf = tf.withColumn("df", F.count("*").over(Window.partitionBy("recording_id", "term")))
    small = weighed(tf.join(size.select("recording_id", "_n").repartition(parts, "recording_id"), "recording_id"))
    if (longest or 0) <= limit:
        return small
    tf = materialise(term_counts(sentences.join(fits.select("recording_id"), "recording_id", "left_anti"), language, ids, every))
    # The recording's size meets its vocabulary, not its words.
    df = tf.groupBy("recording_id", "term").agg(F.count("*").alias("df")).join(size.select("recording_id", "_n"), "recording_id")
    return small.unionByName(weighed(tf.join(df, ["recording_id", "term"])))


def coded(weighted: DataFrame) -> DataFrame:
    """The same weights with each term as a 64-bit number: cheaper to join and to hand to a task.

    Two terms of one recording sharing a number would take some billions of terms.
    """
    return weighted.withColumn("term", F.xxhash64("term"))


def keywords(weighted: DataFrame, count: int = 10) -> DataFrame:
    """The terms a recording keeps coming back to: ``recording_id, rank, term, weight``."""
    total = weighted.groupBy("recording_id", "term").agg(F.round(F.sum("w"), 6).alias("weight"))
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("weight"), "term"))
    return total.withColumn("rank", nth).where((F.col("rank") <= count) & (F.col("weight") > 0))


def long_recordings(sentences: DataFrame, chars: int | None = None) -> DataFrame:
    """The recordings with more characters than one task compares the sentences of."""
    size = sentences.groupBy("recording_id").agg(F.sum(F.length("text")).alias("_chars"))
    return materialise(size.where(F.col("_chars") > (COMPARED_CHARS if chars is None else chars)).select("recording_id"))


def _alike_in_task(threshold: float, ids: tuple[str, ...], out: T.StructType):
    """The pairs of one recording: a block of sentences at a time against the words of all."""
    shape = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        said, tf, w = (rows[c].to_numpy() for c in ("_sent", "tf", "w"))
        names, code = np.unique(rows["term"].to_numpy(), return_inverse=True)
        starts = np.flatnonzero(np.diff(said, prepend=said[0] - 1))
        ends = np.append(starts[1:], len(said))
        first: dict[tuple[bytes, bytes], int] = {}
        same = np.array([first.setdefault((code[a:b].tobytes(), tf[a:b].tobytes()), i) for i, (a, b) in enumerate(zip(starts, ends, strict=True))])
        own = same == np.arange(len(starts))
        copies = np.flatnonzero(~own)
        found = [(same[copies], copies, np.ones(len(copies)))]
        heads = np.flatnonzero(own)
        if len(heads) > 1:
            kept = np.repeat(own, ends - starts)
            code, w = code[kept], w[kept]
            size = (ends - starts)[heads]
            at = np.append(0, np.cumsum(size))
            step = max(1, CELLS // max(len(code), len(names)))
            for low in range(0, len(heads) - 1, step):
                high = min(low + step, len(heads))
                mine = slice(at[low], at[high])
                block = np.zeros((high - low, len(names)))
                block[np.repeat(np.arange(high - low), size[low:high]), code[mine]] = w[mine]
                # Only sentences from the block on: a comes before b.
                rest = slice(at[low], None)
                like = np.add.reduceat(block[:, code[rest]] * w[rest], at[low:-1] - at[low], axis=1)
                a, b = np.nonzero(like >= threshold - 1e-8)
                a, b, sim = a[a < b], b[a < b], like[a, b][a < b]
                found.append((heads[low + a], heads[low + b], sim))
        a, b, sim = (np.concatenate(x) for x in zip(*found, strict=True))

        def named(which):
            return pa.StructArray.from_arrays([rows[c].combine_chunks().take(pa.array(starts[which])) for c in ids], fields=list(shape.field("a").type))
        return pa.table([rows["recording_id"].combine_chunks().take(pa.array(starts[a])), named(a), named(b), pa.array(sim, pa.float64())], schema=shape)
    return run


def similar_pairs(weighted: DataFrame, threshold: float, ids: tuple[str, ...] = ("sent_no",), large: DataFrame | None = None) -> DataFrame:
    """Pairs within a recording at least ``threshold`` alike: ``recording_id, a, b, sim``, a before b.

    Sentences with the same words count once: a copy is paired only with the first of its kind. ``a`` and ``b`` are structs of
    ``ids``. The sentences of a recording are compared in a task, where their words are (so that words partitioned by recording
    are not shuffled again); those of recordings in ``large`` (of over ``COMPARED_WORDS`` words, if not given) by joins, with the same result.
    """
    if large is None:
        size = weighted.groupBy("recording_id").agg(F.count("*").alias("_n"))
        large = materialise(size.where(F.col("_n") > COMPARED_WORDS).select("recording_id"))
    none = large.isEmpty()
    kept = coded(weighted if none else weighted.join(F.broadcast(large), "recording_id", "left_anti"))
    rows = kept.select("recording_id", *ids, "term", F.col("tf").cast("long").alias("tf"), "w")
    rows = rows.withColumn("_sent", F.dense_rank().over(Window.partitionBy("recording_id").orderBy(*ids)))
    me = T.StructType([rows.schema[c] for c in ids])
    out = T.StructType([rows.schema["recording_id"], T.StructField("a", me), T.StructField("b", me), T.StructField("sim", T.DoubleType())])
    small = in_place(rows, [*ids, "term"], _alike_in_task(threshold, ids, out), out).where(F.round("sim", 9) >= threshold)
    if none:
        return small
    return small.unionByName(_similar_by_joins(weighted.join(F.broadcast(large), "recording_id", "left_semi"), threshold, ids))


def _similar_by_joins(weighted: DataFrame, threshold: float, ids: tuple[str, ...]) -> DataFrame:
    """As :func:`similar_pairs` over the cluster.

    Of the sentences that are no copies, two can reach the threshold only if they share one of the few rarest
    words that carry enough of each vector, so only those words are joined; the cosine is
    then computed in full.
    """
    me = F.struct(*ids)
    entry = F.struct(F.col("df").alias("df"), F.col("term").alias("term"), F.col("w").alias("w"), F.col("tf").alias("tf"))
    vec = (weighted.groupBy("recording_id", *ids).agg(F.array_sort(F.collect_list(entry)).alias("_v"))
           .withColumn("_same", F.sha2(F.to_json(F.transform("_v", lambda v: F.struct(v["term"], v["tf"]))), 256)))
    vec = materialise(vec.withColumn("_id", me))
    first = vec.groupBy("recording_id", "_same").agg(F.min("_id").alias("_first"))
    tied = vec.select("recording_id", "_id", "_same").join(first, ["recording_id", "_same"])
    copies = tied.where("_id <> _first").select(
        "recording_id", F.col("_first").alias("a"), F.col("_id").alias("b"), F.lit(1.0).alias("sim"))
    heads = vec.join(first.select("recording_id", F.col("_first").alias("_id")), ["recording_id", "_id"], "left_semi")
    # How much of the vector lies from word i on; the words before it falls short are the prefix.
    rest = F.transform("_v", lambda _, i: F.aggregate(
        F.slice("_v", i + 1, F.size("_v")), F.lit(0.0), lambda a, v: a + v["w"] * v["w"]))
    heads = heads.withColumn("_rest", rest)
    prefix = F.transform(F.filter(F.arrays_zip("_v", "_rest"), lambda z: z["_rest"] >= (threshold - 1e-9) ** 2),
                         lambda z: z["_v"]["term"])
    p = materialise(heads.select("recording_id", "_id", F.map_from_entries(F.transform(
        "_v", lambda v: F.struct(v["term"], v["w"]))).alias("_m"), prefix.alias("_p")))
    rare = p.select("recording_id", "_id", F.explode("_p").alias("term"))
    met = (rare.withColumnRenamed("_id", "a").join(rare.withColumnRenamed("_id", "b"), ["recording_id", "term"])
           .where("a < b").select("recording_id", "a", "b").distinct())
    left = p.select("recording_id", F.col("_id").alias("a"), F.col("_m").alias("_ma"))
    right = p.select("recording_id", F.col("_id").alias("b"), F.col("_m").alias("_mb"))
    dot = F.aggregate(F.map_entries("_ma"), F.lit(0.0),
                      lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("_mb", e["key"]), F.lit(0.0)))
    pairs = (met.join(left, ["recording_id", "a"]).join(right, ["recording_id", "b"])
             .select("recording_id", "a", "b", dot.alias("sim")))
    return pairs.where(F.round("sim", 9) >= threshold).unionByName(copies)


def greedy_leaders(weighted: DataFrame, threshold: float, ids: tuple[str, ...]) -> DataFrame:
    """In order, each item joins the first earlier leader it is like, or leads: ``recording_id, id, leader``.

    Only items that follow somebody are listed. Rounds settle every item whose earlier
    neighbours are settled, all recordings at once.
    """
    pairs = materialise(similar_pairs(weighted, threshold, ids))
    copies, real = pairs.where("sim >= 1"), pairs
    left = materialise(real.select("recording_id", "a", "b").distinct())
    edges, leaders = left, None
    while not left.isEmpty():
        blocked = left.select("recording_id", "b").distinct()
        free = left.select("recording_id", "a").distinct().join(
            blocked.withColumnRenamed("b", "a"), ["recording_id", "a"], "left_anti")
        leaders = materialise(free if leaders is None else leaders.unionByName(free))
        settled = edges.join(leaders, ["recording_id", "a"], "left_semi").select("recording_id", F.col("b").alias("x")).distinct()
        gone = leaders.select("recording_id", F.col("a").alias("x")).unionByName(settled)
        left = materialise(left.join(gone.withColumnRenamed("x", "a"), ["recording_id", "a"], "left_anti")
                           .join(gone.withColumnRenamed("x", "b"), ["recording_id", "b"], "left_anti"))
    if leaders is None:
        return edges.select("recording_id", F.col("b").alias("id"), F.col("a").alias("leader"))
    direct = edges.join(leaders, ["recording_id", "a"], "left_semi").groupBy("recording_id", "b").agg(F.min("a").alias("leader"))
    # A copy of an item that itself follows a leader follows the same one.
    through = (copies.select("recording_id", F.col("a").alias("_f"), "b")
               .join(direct.select("recording_id", F.col("b").alias("_f"), "leader"), ["recording_id", "_f"])
               .select("recording_id", "b", "leader"))
    return direct.unionByName(through).groupBy("recording_id", F.col("b").alias("id")).agg(F.min("leader").alias("leader"))
