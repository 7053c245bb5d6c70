"""Extractive summaries: ranking, choosing, titles and pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions import clock
from colloquy.functions import lexicons as lx
from colloquy.functions import text as tx
from colloquy.operators import terms as tm
from colloquy.plans.store import materialise
from colloquy.plans.tasks import in_place

KEYS = ["recording_id"]
DAMPING, ROUNDS = 0.85, 40
ABSOLUTE, RELATIVE = 1e-9, 1e-5
#: Decimal digits of a score that are given.
DIGITS = 10
REDUNDANCY = 0.62
#: Recordings up to this many weighted words are ranked inside one task.
TASK_WORDS = 200_000
#: Best-ranked sentences looked at together when choosing; more are taken if they run out.
BATCH = 120

_SCORES = [T.StructField("sent_no", T.LongType()), T.StructField("score", T.DoubleType())]


#: Rows handed to a task at once, of as many recordings as they hold.
BUCKET_ROWS = 65_536


def by_recording(rows: DataFrame, many: int, one, out: T.StructType) -> DataFrame:
    """``one(rows of a recording) -> rows out``, both Arrow tables; of ``many`` rows, some ``BUCKET_ROWS`` share a call."""
    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("recording_id")
        ids = table["recording_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(ids, prepend=-1))
        made = [one(table.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True)]
        return pa.concat_tables(m.cast(shape) for m in made)

    shape = to_arrow_schema(out)
    buckets = -(-many // BUCKET_ROWS) or 1
    return rows.groupBy(F.pmod(F.xxhash64("recording_id"), F.lit(buckets)).alias("_bucket")).applyInArrow(each, out)


def _settled(new, old):
    return np.all(np.abs(new - old) <= ABSOLUTE + RELATIVE * np.abs(old))


def _rank_one(rows: pa.Table) -> pa.Table:
    """The walk's resting point for one recording, without ever forming the similarities.

    A sentence's likeness to all others is its words times the words' totals, so each
    step costs one pass over the words.
    """
    ids, place = np.unique(rows["sent_no"].to_numpy(), return_inverse=True)
    n = len(ids)
    scores = np.full(n, 1.0 / n)
    if n > 1:
        said = rows["term"].is_valid().to_numpy()
        row, w = place[said], rows["w"].filter(rows["term"].is_valid()).to_numpy()
        names, col = np.unique(rows["term"].drop_null().to_numpy(), return_inverse=True)

        def others(z):
            per_term = np.bincount(col, weights=w * z[row], minlength=len(names))
            return np.bincount(row, weights=w * (per_term[col] - w * z[row]), minlength=n)

        total = others(np.ones(n))
        alone = total <= 0
        for _ in range(ROUNDS):
            z = np.where(alone, 0.0, scores / np.where(alone, 1.0, total))
            new = (1 - DAMPING) / n + DAMPING * (others(z) + scores[alone].sum() / n)
            done, scores = _settled(new, scores), new
            if done:
                break
    return pa.table({"recording_id": rows["recording_id"].combine_chunks().take(pa.array(np.zeros(n, dtype=np.int64))),
                     "sent_no": ids, "score": scores})


def _rank_many(rows: DataFrame) -> DataFrame:
    """The same walk as joins and sums over all the given recordings at once."""
    words = materialise(rows.where("term is not null").select("recording_id", "sent_no", "term", "w"))
    sents = rows.select("recording_id", "sent_no").distinct()
    size = sents.groupBy("recording_id").agg(F.count("*").alias("n"))
    here, there = ["recording_id", "sent_no"], ["recording_id", "term"]

    def others(z: DataFrame) -> DataFrame:
        e = words.join(z, here)
        per_term = e.groupBy(*there).agg(F.sum(F.col("w") * F.col("z")).alias("_t"), F.count("*").alias("_c"))
        lone = F.when(F.col("_c") == 1, 0.0).otherwise(F.col("w") * (F.col("_t") - F.col("w") * F.col("z")))
        return e.join(per_term, there).groupBy(*here).agg(F.sum(lone).alias("o"))

    base = materialise(sents.join(size, "recording_id")
                       .join(others(sents.withColumn("z", F.lit(1.0))).withColumnRenamed("o", "total"), here, "left")
                       .withColumn("total", F.coalesce("total", F.lit(0.0))))
    state = materialise(base.withColumn("score", F.lit(1.0) / F.col("n")))
    finished = None
    for _ in range(ROUNDS):
        alone = F.col("total") <= 0
        z = state.select(*here, F.when(alone, 0.0).otherwise(F.col("score") / F.col("total")).alias("z"))
        adrift = state.groupBy("recording_id").agg(F.sum(F.when(alone, F.col("score")).otherwise(0.0)).alias("_m"))
        step = (state.join(others(z), here, "left").join(adrift, "recording_id")
                .withColumn("_new", (1 - DAMPING) / F.col("n") + DAMPING * (
                    F.coalesce("o", F.lit(0.0)) + F.col("_m") / F.col("n"))))
        moved = F.abs(F.col("_new") - F.col("score")) > ABSOLUTE + RELATIVE * F.abs("score")
        step = materialise(step.withColumn("_moved", moved)
                           .select(*here, "n", "total", F.col("_new").alias("score"), "_moved"))
        going = step.groupBy("recording_id").agg(F.max("_moved").alias("_going"))
        step = step.drop("_moved").join(going, "recording_id")
        rested = step.where("not _going").drop("_going")
        finished = rested if finished is None else finished.unionByName(rested)
        state = step.where("_going").drop("_going")
        if state.isEmpty():
            return finished.select(*here, "score")
    return finished.unionByName(state).select(*here, "score")


def textrank(sentences: DataFrame, weighted: DataFrame, task_words: int = TASK_WORDS) -> DataFrame:
    """How much of its recording each sentence speaks for: ``recording_id, sent_no, score``.

    Recordings that fit a task are ranked there; the others by joins over the cluster, with the same sums in another order:
    scores are given to ten digits, so that what follows (ties go by place) does not depend on that order.
    """
    all_ = sentences.select("recording_id", "sent_no")
    rows = all_.join(tm.coded(weighted).select("recording_id", "sent_no", "term", "w"), ["recording_id", "sent_no"], "left")
    out = T.StructType([sentences.schema["recording_id"], *_SCORES])
    size = materialise(weighted.select("recording_id").unionByName(all_.select("recording_id")).groupBy("recording_id").agg(F.count("*").alias("_rows")))
    big = size.where(F.col("_rows") > task_words).select("recording_id")
    many = size.agg(F.sum("_rows")).first()[0] or 0
    if big.isEmpty():
        return by_recording(rows, many, _rank_one, out).withColumn("score", F.round("score", DIGITS))
    small = by_recording(rows.join(big, "recording_id", "left_anti"), many, _rank_one, out)
    ranked = small.unionByName(_rank_many(materialise(rows.join(big, "recording_id", "left_semi"))))
    return ranked.withColumn("score", F.round("score", DIGITS))


def how_many(n: Column, length: str = "medium") -> Column:
    """How many sentences a summary keeps out of ``n``."""
    share, fewest, most = lx.SUMMARY_LENGTHS.get(length, lx.SUMMARY_LENGTHS["medium"])
    scaled = F.greatest(F.lit(fewest), F.least(F.lit(most), F.bround(n * share)))
    return F.when(n <= fewest, n).otherwise(scaled).cast("long")


def _choose(redundancy: float, most: int):
    """Among a recording's best candidates, those unlike every one chosen before; if they ran out, a last row says where to go on."""
    def choose(rows: pa.Table) -> pa.Table:
        ids, first, place = np.unique(rows["sent_no"].to_numpy(), return_index=True, return_inverse=True)
        score, held = rows["score"].to_numpy()[first], rows["held"].to_numpy()[first]
        room = int(rows["k"][0].as_py())
        said = rows["term"].is_valid()
        names, col = np.unique(rows["term"].drop_null().to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), max(1, len(names))))
        m[place[said.to_numpy()], col] = rows["w"].filter(said).to_numpy()
        order = np.lexsort((-ids, -score, ~held))
        chosen, near, new = int(held.sum()), np.zeros(len(ids)), []
        for i in order[:chosen]:
            near = np.maximum(near, m @ m[i])
        for i in order[chosen:]:
            if chosen >= room:
                break
            if near[i] < redundancy:
                near, chosen = np.maximum(near, m @ m[i]), chosen + 1
                new.append(i)
        last = [order[-1]] if chosen < room and len(ids) - int(held.sum()) == most else []
        at = np.array(new + last, dtype=np.int64)
        return pa.table({"recording_id": rows["recording_id"].combine_chunks().take(pa.array(first[at])),
                         "sent_no": ids[at], "score": score[at], "more": np.arange(len(at)) >= len(new)})
    return choose


def _next_best(rows: DataFrame, cursor: DataFrame | None, most: int) -> DataFrame:
    """The best ``most`` rows of each recording below its place in ``cursor(recording_id, _low)``; of all recordings without one.

    Tasks keep that many rows of a recording before anything is shuffled, and the rows themselves are never written again.
    """
    best = Window.partitionBy("recording_id").orderBy(F.desc("score"), F.desc("sent_no"))
    left = rows if cursor is None else rows.join(cursor, "recording_id").where(F.struct("score", "sent_no") < F.col("_low"))
    return left.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).drop("_r", *([] if cursor is None else ["_low"]))


def select_diverse(scores: DataFrame, weighted: DataFrame, k: DataFrame, redundancy: float = REDUNDANCY) -> DataFrame:
    """The ``k`` best sentences of each recording, none like one already chosen.

    ``k(recording_id, k)``. The best ``BATCH`` are settled together; a recording still short of its ``k`` goes on below them,
    with twice as many each time, while the others are done.
    """
    here = ["recording_id", "sent_no"]
    out = T.StructType([scores.schema["recording_id"], *_SCORES, T.StructField("more", T.BooleanType())])
    w = tm.coded(weighted).select(*here, "term", "w")
    rows, most, chosen, cursor, many = scores.select(*here, "score"), BATCH, None, None, weighted.count()
    while True:
        pool = _next_best(rows, cursor, most).withColumn("held", F.lit(False))
        if chosen is not None:
            pool = pool.unionByName(chosen.join(cursor.select("recording_id"), "recording_id", "left_semi").withColumn("held", F.lit(True)))
        step = materialise(by_recording(pool.join(k, "recording_id").join(w, here, "left"), many, _choose(redundancy, most), out))
        new = step.where("not more").select(*here, "score")
        chosen = new if chosen is None else chosen.unionByName(new)
        # The last row of a recording that is short of sentences is where it goes on.
        cursor = materialise(step.where("more").select("recording_id", F.struct("score", "sent_no").alias("_low")))
        if cursor.isEmpty():
            return chosen
        most *= 2


def _spend(most: int):
    def spend(rows: pa.Table) -> pa.Table:
        """Take, best first, every sentence that still fits what is left; a last row says where to go on."""
        rows = rows.sort_by([("score", "descending"), ("sent_no", "descending")])
        left, kept = rows["left"][0].as_py(), []
        for at, cost in enumerate(rows["cost"].to_pylist()):
            if cost <= left and left > 0:
                kept.append(at)
                left -= cost
        last = [len(rows) - 1] if len(rows) == most and left > 0 else []
        at = pa.array(kept + last, pa.int64())
        return rows.select(["recording_id", "sent_no", "score"]).take(at).append_column(
            "more", pa.array([False] * len(kept) + [True] * len(last), pa.bool_())).append_column("left", pa.array([left] * len(at), pa.int64()))
    return spend


def reduce_to_budget(sentences: DataFrame, scores: DataFrame, budget: DataFrame, language: Column | str | None = None) -> DataFrame:
    """The best sentences that fit ``budget(recording_id, budget)`` tokens, in spoken order.

    A recording already within its budget is kept whole.
    """
    here = ["recording_id", "sent_no"]
    cost = tx.estimate_tokens(F.col("text"), language)
    costed = sentences.select(*here, cost.alias("cost")).join(budget, "recording_id")
    total = materialise(costed.groupBy("recording_id").agg(F.sum("cost").alias("_total"), F.first("budget").alias("_budget")))
    over = total.where((F.col("_total") > F.col("_budget")) & (F.col("_budget") > 0)).select("recording_id", F.col("_budget").alias("left"))
    whole = costed.join(over, "recording_id", "left_anti").select(*here)
    rows = materialise(costed.drop("budget").join(over, "recording_id").where("cost <= left").drop("left").join(scores.select(*here, "score"), here))
    out = T.StructType([*(rows.schema[c] for c in ("recording_id", "sent_no", "score")), T.StructField("more", T.BooleanType()), T.StructField("left", T.LongType())])
    kept, left, cursor, most, many = whole, over, None, BATCH, rows.count()
    while True:
        batch = _next_best(rows.join(left, "recording_id").where("cost <= left"), cursor, most)
        done = materialise(by_recording(batch, many, _spend(most), out))
        kept = kept.unionByName(done.where("not more").select(*here))
        after = materialise(done.where("more").select("recording_id", "left", F.struct("score", "sent_no").alias("_low")))
        if after.isEmpty():
            return sentences.join(kept, here, "left_semi")
        left, cursor, most = after.select("recording_id", "left"), after.select("recording_id", "_low"), 2 * most


def _summary_in_task(redundancy: float, count: int, out: T.StructType):
    """The chosen sentences of one recording and the terms that may be among its ``count`` heaviest, from its words and an empty one a sentence."""
    shape = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        word = pc.not_equal(rows["term"], "")
        said = pa.table({"recording_id": rows["recording_id"], "sent_no": rows["sent_no"], "w": rows["w"],
                         "term": pc.if_else(word, rows["term"].combine_chunks().dictionary_encode("encode").indices.cast(pa.int64()), None)})
        ranked = _rank_one(said)
        ids, score = ranked["sent_no"].to_numpy(), np.floor(ranked["score"].to_numpy() * 10 ** DIGITS + 0.5) / 10 ** DIGITS
        heard = said.filter(word)
        place, w = np.searchsorted(ids, heard["sent_no"].to_numpy()), heard["w"].to_numpy()
        names, first, code = np.unique(heard["term"].to_numpy(), return_index=True, return_inverse=True)
        room, near, chosen = int(rows["k"][0].as_py()), np.zeros(len(ids)), []
        for i in np.lexsort((-ids, -score)):
            if len(chosen) >= room:
                break
            if near[i] < redundancy:
                chosen.append(i)
                mine, all_ = place == i, np.zeros(len(names))
                all_[code[mine]] = w[mine]
                near = np.maximum(near, np.bincount(place, weights=w * all_[code], minlength=len(ids)))
        total = np.bincount(code, weights=w, minlength=len(names))
        # Weights count to six digits: whoever may be among the heaviest then.
        heavy = np.flatnonzero(total >= (np.sort(total)[-count] if len(total) > count else 0) - 1e-5)
        terms = rows["term"].filter(word).combine_chunks().take(pa.array(first[heavy]))
        made = {"recording_id": rows["recording_id"].combine_chunks().take(pa.array(np.zeros(len(chosen) + len(heavy), np.int64))),
                "sent_no": pa.concat_arrays([pa.array(ids[chosen], pa.int64()), pa.nulls(len(heavy), pa.int64())]),
                "score": pa.concat_arrays([pa.array(score[chosen], pa.float64()), pa.nulls(len(heavy), pa.float64())]),
                "term": pa.concat_arrays([pa.nulls(len(chosen), pa.string()), terms.cast(pa.string())]),
                "w": pa.concat_arrays([pa.nulls(len(chosen), pa.float64()), pa.array(total[heavy], pa.float64())])}
        return pa.table(made, schema=shape)
    return run


def _chosen_and_terms(sentences: DataFrame, language: Column | str | None, length: str, count: int, task_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """``recording_id, sent_no, score`` of the summaries' sentences, and weights ``recording_id, term, w`` that hold the heaviest terms.

    Recordings that fit a task are ranked and chosen from where their words are counted, so that words are neither written nor shuffled.
    """
    large = tm.long_recordings(sentences, task_chars)
    none = large.isEmpty()
    small = sentences if none else sentences.join(F.broadcast(large), "recording_id", "left_anti")
    rows = tm.weights(small, language, every=True).select("recording_id", F.col("sent_no").cast("long").alias("sent_no"), "term", "w")
    rows = rows.withColumn("k", how_many(F.count_if(F.col("term") == "").over(Window.partitionBy("recording_id")), length))
    out = T.StructType([rows.schema["recording_id"], *_SCORES, T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])
    found = materialise(in_place(rows, ["sent_no", "term"], _summary_in_task(REDUNDANCY, count, out), out))
    chosen, terms = found.where("sent_no is not null").select("recording_id", "sent_no", "score"), found.where("sent_no is null").select("recording_id", "term", "w")
    if none:
        return chosen, terms
    rest = sentences.join(F.broadcast(large), "recording_id", "left_semi")
    w = materialise(tm.weights(rest, language))
    scores = materialise(textrank(rest, w))
    k = scores.groupBy("recording_id").agg(how_many(F.count("*"), length).alias("k"))
    return (chosen.unionByName(select_diverse(scores, w, k).select("recording_id", "sent_no", "score")),
            terms.unionByName(w.select("recording_id", "term", "w")))


def extractive_summary(sentences: DataFrame, language: Column | str | None = None, length: str = "medium", task_chars: int | None = None) -> DataFrame:
    """Abstract, points and keywords of every recording: ``recording_id, abstract, points, keywords``."""
    here = ["recording_id", "sent_no"]
    chosen, w = _chosen_and_terms(sentences, language, length, 10, task_chars)
    # No more than the longest summary's sentences are chosen, so these groups are small.
    mine = Window.partitionBy("recording_id")
    ranked = chosen.withColumn("_r", F.row_number().over(mine.orderBy(F.desc("score"), "sent_no"))).withColumn(
        "_n", F.count("*").over(mine))
    opening = F.col("_r") <= F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("_n") / 3)))
    cols = [c for c in ("start_ms", "speaker") if c in sentences.columns]
    full = ranked.withColumn("_open", opening).join(sentences.select(*here, "text", *cols), here)
    point = F.struct("sent_no", *(F.col(c) for c in cols), "text")
    body = full.groupBy("recording_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_open"), F.struct("sent_no", "text")))),
                                 lambda x: x["text"]), " ").alias("abstract"),
        F.sort_array(F.collect_list(F.when(~F.col("_open"), point))).alias("points"))
    words = tm.keywords(w, 10).groupBy("recording_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return body.join(words, "recording_id", "left")


# --- titles ------------------------------------------------------------------

MAX_WORDS, MAX_CHARS = 9, 72
_TRAILING = " ,;:.!?…-–—\"'«»"
_CLAUSE = r"(?iU),|;|:|\bche\b|\bthat\b|\bma\b|\bbut\b|\be\b|\band\b"


def _trimmed(c: Column) -> Column:
    return F.btrim(F.btrim(c, F.lit(_TRAILING)))


def _fit(text: Column, dangling: Column) -> Column:
    """The text without dangling words at its ends, if that is short enough; else null."""
    def solid(ws):
        return F.filter(F.sequence(F.lit(1), F.size(ws)), lambda i: ~F.array_contains(
            dangling, tx.fold(F.btrim(F.element_at(ws, i), F.lit(_TRAILING)))))

    def kept(ws, at):
        return F.slice(ws, F.array_min(at), F.array_max(at) - F.array_min(at) + 1)

    return tx.let(tx.words(_trimmed(text)), lambda ws: tx.let(
        F.when(F.size(ws) > 0, solid(ws)), lambda at: tx.let(
            F.when(F.size(at) > 0, kept(ws, at)),
            lambda k: F.when(F.size(k) <= MAX_WORDS, _trimmed(F.array_join(k, " "))))))


def _by_language(table: dict, lang: Column, make) -> Column:
    return F.when(lang == "it", make(table["it"])).otherwise(make(table["en"]))


def shorten(sentence: Column, language: Column) -> Column:
    """A spoken sentence as a title, or empty: opener off, longest clean clause, no loose ends."""
    lang = tx.language_of(language)
    dangling = _by_language(lx.DANGLING, lang, lx.literal_array)
    openers = _by_language(lx.OPENERS, lang, lambda ws: F.lit(
        "^(?:" + "|".join(sorted(ws, key=len, reverse=True)) + ")(?= |$)"))

    def opened(t):
        return tx.let(F.regexp_substr(tx.fold(t), openers), lambda o: F.when(o.isNull(), t).otherwise(
            F.btrim(F.ltrim(F.substring(t, F.length(o) + 1, F.length(t)), F.lit(_TRAILING)))))

    def widest(t):
        fitted = F.transform(F.split(t, _CLAUSE), lambda p: _fit(p, dangling))
        sized = F.transform(F.filter(fitted, lambda c: c.isNotNull()), lambda c, i: F.struct(
            (-F.size(tx.words(c))).alias("n"), i.alias("i"), c.alias("c")))
        return F.array_min(F.filter(sized, lambda z: z["n"] <= -3))["c"]

    def best(t):
        opening = _fit(F.array_join(F.slice(tx.words(t), 1, MAX_WORDS), " "), dangling)
        return F.coalesce(_fit(t, dangling), widest(t), opening, F.lit(""))

    def bounded(b):
        cut = F.btrim(F.regexp_replace(F.substring(b, 1, MAX_CHARS), r" [^ ]*$", ""), F.lit(_TRAILING))
        return F.when(F.length(b) > MAX_CHARS, cut).otherwise(b)

    title = tx.let(_trimmed(tx.collapse(F.coalesce(sentence, F.lit("")))),
                   lambda t: tx.let(opened(t), lambda u: tx.let(best(u), bounded)))
    return tx.let(title, lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.substring(b, 2, MAX_CHARS)))


def title_from_summary(summary_text: Column, language: Column) -> Column:
    """From the first line of a written page that is prose."""
    lines = F.transform(F.split(F.coalesce(summary_text, F.lit("")), r"\R"), lambda s: F.trim(s))
    prose = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"^[#_\-*>]"))
    return shorten(F.get(tm.sentence_array(F.coalesce(F.get(prose, 0), F.lit(""))), 0), language)


def suggest_titles(sentences: DataFrame, language: str = "language", summaries: DataFrame | None = None) -> DataFrame:
    """A title per recording: from its summary, else its best sentence, else its terms."""
    w = materialise(tm.weights(sentences, F.col(language)))
    scores = textrank(sentences, w)
    best = scores.groupBy("recording_id").agg(F.max_by("sent_no", F.struct("score", "sent_no")).alias("sent_no"))
    first = best.join(sentences.select("recording_id", "sent_no", "text", F.col(language).alias("_lang")), ["recording_id", "sent_no"])
    terms = tm.keywords(w, 4).groupBy("recording_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("_terms"))
    t = first.join(terms, "recording_id", "left")
    # Each candidate is worked out once, as a column of its own.
    t = t.withColumn("_cand", shorten(F.col("text"), F.col("_lang")))
    t = t.withColumn("_cand", F.when(F.col("_cand") != "", F.col("_cand")).otherwise(
        F.coalesce(shorten(F.col("_terms"), F.col("_lang")), F.lit(""))))
    if summaries is not None:
        t = t.join(summaries.select("recording_id", "summary"), "recording_id", "left")
        written = title_from_summary(F.col("summary"), F.col("_lang"))
        t = t.withColumn("_cand", F.coalesce(F.nullif(written, F.lit("")), F.col("_cand")))
    return t.select("recording_id", F.col("_cand").alias("title"))


# --- pages -------------------------------------------------------------------

def page(summaries: DataFrame) -> DataFrame:
    """The summary as markdown; a heading with nothing under it is left out.

    ``summaries``: ``recording_id, title, engine, written (string), duration_ms, language, abstract,
    points, keywords`` and optionally ``decisions``, ``actions`` (arrays like ``points``).
    """
    lang = tx.language_of(F.col("language"))

    def word(key):
        return F.when(lang == "it", F.lit(lx.PAGE_WORDS["it"][key])).otherwise(F.lit(lx.PAGE_WORDS["en"][key]))

    def bullets(name):
        line = F.transform(name, lambda p: F.concat(
            F.lit("- "), F.when(p["start_ms"].isNotNull(), F.concat(F.lit("`["), clock.format_clock(p["start_ms"]), F.lit("]` "))).otherwise(""),
            F.when(F.coalesce(p["speaker"], F.lit("")) != "", F.concat(F.lit("**"), p["speaker"], F.lit("** "))).otherwise(""), p["text"]))
        return F.array_join(line, "\n")

    def section(key, body, given):
        return F.when(given, F.concat(F.lit("## "), word(key), F.lit("\n\n"), body, F.lit("\n")))

    minutes = F.bround(F.col("duration_ms") / 60000).cast("int").cast("string")
    timed = F.replace(F.replace(F.replace(word("made_by"), F.lit("{engine}"), F.col("engine")), F.lit("{when}"), F.col("written")), F.lit("{minutes}"), minutes)
    plain = F.replace(F.replace(word("made_by_untimed"), F.lit("{engine}"), F.col("engine")), F.lit("{when}"), F.col("written"))
    head = F.rtrim(F.concat(F.lit("# "), word("title"), F.lit(": "), F.coalesce("title", F.lit(""))), F.lit(": "))
    made = F.concat(F.lit("\n_"), F.when(F.coalesce("duration_ms", F.lit(0)) > 0, timed).otherwise(plain), F.lit("_\n"))
    parts = [head, made, section("abstract", F.col("abstract"), F.coalesce("abstract", F.lit("")) != "")]
    parts += [section(key, bullets(key), F.size(key) > 0) for key in ("points", "decisions", "actions") if key in summaries.columns]
    parts.append(section("keywords", F.array_join("keywords", ", "), F.size("keywords") > 0))
    return summaries.select("recording_id", F.concat_ws("\n", *parts).alias("page"))
