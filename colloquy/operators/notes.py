"""Model answers to notes, and the passes that produce them.

The model itself is outside: ``callouts.map_text`` is the seam.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions import clock
from colloquy.functions import lexicons as lx
from colloquy.functions import text as tx
from colloquy.operators import terms as tm
from colloquy.plans.folds import fold_blocks
from colloquy.plans.ordered import in_order
from colloquy.plans.store import materialise

# --- fixed values: what an answer looks like ---------------------------------
HEADING = r"^\s{0,3}(?:#{1,6}\s*(.+?)\s*#*|\*\*(.+?)\*\*|(.+?):)\s*$"
BULLET = r"^\s*(?:[-*•]|\d{1,2}[.)])\s+(.*)$"
CLOCK = r"`?[\[(]?(\d{1,3}:\d{2}(?::\d{2})?)[\])]?`?"
SPEAKER = r"[(\[]\s*(SPEAKER[ _]?\d{1,2}|[A-Z][\w'’-]{1,30})\s*[)\]]|\*\*(.+?)\*\*"
PAGE_HEADING = (r"^\s{0,3}(?:#{1,6}\s*(.+?)\s*#*|\*\*(.+?)\*\*:?|__(.+?)__:?"
                r"|\[(?!\d)([^\[\]]{1,40})\])\s*$")
LABELLED = r"^\s{0,3}([^\n:]{1,40}):\s+(\S.*)$"
POINT_CLOCK = r"^`?\[?(\d{1,2}:\d{2}(?::\d{2})?)\]?`?[\s:—-]*"
POINT_SPEAKER = r"^\*\*(.+?)\*\*[\s:—-]*"
FENCE = "-----BEGIN TRANSCRIPT-----"
MIN_ANSWER = 40
SAME_HEADING = 0.62
FALLBACK = "fact"
#: Known headings that a written one is compared with in one pass.
KIND_BLOCK = 200
EXAMPLE_SHARE, EXAMPLE_MIN_WORDS, EXAMPLE_STEM = 0.85, 4, 4
SENTENCE_OVERHEAD = 8
DATES = (r"(?i)\b(\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?"
         r"|\d{1,2}\s+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre"
         r"|january|february|march|april|may|june|july|august|september|october|november|december)"
         r"|(?:lunedi|martedi|mercoledi|giovedi|venerdi|sabato|domenica"
         r"|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b")
NUMBERS = (r"(?i)\b(\d+(?:[.,]\d+)?\s*(?:%|percento|per cento|euro|€|\$|GB|MB|TB|KB|minuti|minute|minutes|secondi|seconds"
           r"|ore|hours|giorni|days|settimane|weeks|mesi|months|utenti|users|ticket|tickets))\b")
STRIPPED = " \t-—–:•"

ANSWER = ["recording_id", "chunk_idx"]


def _group(line: Column, pattern: str, count: int) -> Column:
    """The text of whichever of the first ``count`` groups took part in the match."""
    return F.concat(*[F.regexp_extract(line, pattern, i + 1) for i in range(count)])


def clean_answers(answers: DataFrame) -> DataFrame:
    """``answer`` without the model's thinking and without its echo of ``prompt``.

    What follows the transcript's fence goes, and so do leading lines found in the prompt;
    an answer that was echoed and has little left becomes empty.
    """
    spoken = F.regexp_replace(F.coalesce("answer", F.lit("")), r"(?is)<think>.*?</think>\s*", "")
    a = answers.withColumn("_t", tx.strip(F.regexp_replace(spoken, r"(?is)<think>.*$", "")))
    bare = FENCE.strip("-")
    fence = F.when(F.contains("_t", F.lit(FENCE)), F.lit(FENCE)).when(F.contains("_t", F.lit(bare)), F.lit(bare))
    a = a.withColumn("_cut", F.when(fence.isNotNull(), tx.strip(F.split_part("_t", fence, F.lit(1)))).otherwise(F.col("_t")))
    a = a.withColumns({"_fenced": fence.isNotNull(), "_lines": F.split("_cut", r"\R"),
                       "_flat": tx.collapse(F.coalesce("prompt", F.lit("")))})
    packed = F.transform("_lines", tx.collapse)
    own = F.filter(F.transform(packed, lambda p, i: F.when((p != "") & ~F.contains("_flat", p), i)), lambda i: i.isNotNull())
    a = a.withColumn("_first", F.when(F.col("_flat") == "", 0).otherwise(F.coalesce(F.array_min(own), F.size("_lines"))))
    echoed = F.col("_fenced") | F.exists(F.slice("_lines", F.lit(1), F.col("_first")), lambda s: tx.collapse(s) != "")
    left = tx.strip(F.array_join(F.slice("_lines", F.col("_first") + 1, F.size("_lines")), "\n"))
    a = a.withColumn("_left", F.when(F.col("_first") > 0, left).otherwise(F.col("_cut")))
    return a.withColumn("answer", F.when(echoed & (F.length("_left") < MIN_ANSWER), "").otherwise(F.col("_left"))).drop(
        "_t", "_cut", "_fenced", "_lines", "_flat", "_first", "_left")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def heading_likeness(written: pd.Series, known: pd.Series) -> pd.Series:
    """How like each of the known headings a written one is, 0 to 1."""
    return pd.Series([[SequenceMatcher(None, a, b).ratio() for b in bs] for a, bs in zip(written, known, strict=True)])


def route_headings(headings: DataFrame, kinds: DataFrame, language: str = "it") -> DataFrame:
    """The kind each written heading means: ``heading, kind``, null where none is near enough.

    The headings of the language and the English ones are known. Equal after folding wins;
    else the nearest, unless two kinds are equally near. Only distinct headings are compared.
    """
    # A catalogue's headings, ``KIND_BLOCK`` of them at a time as literals.
    table = kinds.where(F.col("language").isin(language, "en")).orderBy("ord", "language").select("name", "heading").toLocalIterator()
    h = headings.select("heading").distinct().withColumn("key", tx.heading_key(F.col("heading"))).where("key <> ''")
    blocks = []
    while block := list(islice(table, KIND_BLOCK)):
        known = F.array(*[F.struct(F.lit(k["name"]).alias("name"), tx.heading_key(F.lit(k["heading"])).alias("key")) for k in block])
        b = h.withColumn("known", known)
        exact = F.get(F.filter("known", lambda k: k["key"] == F.col("key")), 0)["name"]
        b = b.withColumn("exact", exact).withColumn("near", heading_likeness("key", F.transform("known", lambda k: k["key"])))
        scored = F.zip_with("known", "near", lambda k, s: F.struct(s.alias("s"), k["name"].alias("name")))
        b = b.withColumn("scored", scored).withColumn("top", F.array_max(F.transform("scored", lambda x: x["s"])))
        names = F.transform(F.filter("scored", lambda x: x["s"] == F.col("top")), lambda x: x["name"])
        blocks.append(b.select("heading", F.lit(len(blocks)).alias("block"), "exact", "top", names.alias("names")))
    if not blocks:
        return h.select("heading", F.lit(None).cast("string").alias("kind"))
    met = reduce(DataFrame.unionByName, blocks)
    # One row a block: the first exact name, and the names of the highest likeness over all blocks.
    met = met.groupBy("heading").agg(F.min_by("exact", F.when(F.col("exact").isNotNull(), F.col("block"))).alias("exact"), F.max("top").alias("top"),
                                     F.collect_list(F.struct("top", "names")).alias("all"))
    best = F.array_distinct(F.flatten(F.transform(F.filter("all", lambda x: x["top"] == F.col("top")), lambda x: x["names"])))
    near = F.when((F.col("top") >= SAME_HEADING) & (F.size(best) == 1), F.get(best, 0))
    return met.select("heading", F.coalesce("exact", near).alias("kind"))


def _lines(answers: DataFrame, keep: list[str]) -> DataFrame:
    return answers.select(*keep, F.posexplode(F.split(F.coalesce("answer", F.lit("")), r"\R")).alias("line_no", "line"))


def parse_notes(answers: DataFrame, kinds: DataFrame, language: str = "it") -> DataFrame:
    """One note per bullet of each pass's answer.

    The kind is the last heading's, ``fact`` under one nobody knows; a bullet without a
    minute inherits the one before it, or the chunk's start.
    """
    lines = materialise(_lines(answers, [*ANSWER, "span_start_ms"]))
    bullet = F.regexp_extract("line", BULLET, 1)
    is_bullet = F.col("line").rlike(BULLET)
    written = F.when(F.col("line").rlike(HEADING) & ~is_bullet, _group(F.col("line"), HEADING, 3))
    marked = lines.withColumn("heading", written)
    routes = route_headings(marked.where("heading is not null"), kinds, language)
    m = marked.join(routes, "heading", "left")      # one row per distinct heading: small, joined by size
    kind = F.when(F.col("heading").isNotNull() & (tx.heading_key(F.col("heading")) != ""), F.coalesce("kind", F.lit(FALLBACK)))
    # An answer is bounded by the pass's token budget, so its lines fit a window.
    w = Window.partitionBy(*ANSWER).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("type", F.coalesce(F.last(kind, ignorenulls=True).over(upto), F.lit(FALLBACK)))
    n = m.where(is_bullet).withColumn("_b", F.trim(bullet)).where("_b <> ''")
    n = n.withColumn("_clock", F.regexp_extract("_b", CLOCK, 1))
    n = n.withColumn("_b", F.when(F.col("_clock") != "", F.trim(F.regexp_replace("_b", f"^(.*?){CLOCK}(.*)$", "$1$3"))).otherwise(F.col("_b")))
    n = n.withColumn("speaker", F.nullif(F.trim(_group(F.col("_b"), SPEAKER, 2)), F.lit("")))
    n = n.withColumn("_b", F.when(F.col("speaker").isNotNull(), F.trim(F.regexp_replace("_b", f"^(.*?)(?:{SPEAKER})(.*)$", "$1$4"))).otherwise(F.col("_b")))
    n = n.withColumn("text", F.btrim("_b", F.lit(STRIPPED))).where("text <> ''")
    said = F.when(F.col("_clock") != "", clock.clock_ms(F.col("_clock")))
    n = n.withColumn("ts_start_ms", F.coalesce(F.last(said, ignorenulls=True).over(upto), "span_start_ms"))
    parts = [F.col("chunk_idx").cast("string"), F.coalesce(F.col("ts_start_ms").cast("string"), F.lit("None")), F.substring("text", 1, 40)]
    note_id = F.concat(F.lit("n"), F.substring(F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\x00"))]), 256), 1, 10))
    return n.select(*ANSWER, F.col("line_no").cast("long").alias("line_no"), note_id.alias("note_id"), "type", "text", "ts_start_ms", "speaker")


def unknown_headings(answers: DataFrame, kinds: DataFrame, language: str = "it") -> DataFrame:
    """The headings of each answer that mean no kind."""
    lines = _lines(answers, ANSWER)
    written = _group(F.col("line"), HEADING, 3)
    h = lines.where(F.col("line").rlike(HEADING) & ~F.col("line").rlike(BULLET)).withColumn("heading", written)
    return h.join(route_headings(h, kinds, language).where("kind is null"), "heading").select(*ANSWER, F.trim("heading").alias("heading")).distinct()


def number_notes(notes: DataFrame) -> DataFrame:
    """``note_no``: the notes of a recording in page order, from 0."""
    out = in_order(notes, ["recording_id"], ["chunk_idx", "line_no"], block=F.floor(F.col("chunk_idx") / 64), sums={"note_no": F.lit(1)})
    return out.withColumn("note_no", F.col("note_no") - 1)


def drop_example_copies(notes: DataFrame, examples: DataFrame, language: Column | str | None = None) -> DataFrame:
    """Without the notes that are a line of the prompt's own example, reworded or cut.

    ``examples(line_no, text)``: the few lines of a prompt.
    """
    def stems(df, ids):
        said = df.withColumn("text", F.replace(F.regexp_replace("text", r"\([^)]*\)", " "), F.lit("’"), F.lit("'")))
        return tm.content_terms(said, language, ids).withColumn("stem", F.substring(tx.fold(F.col("term")), 1, EXAMPLE_STEM))

    lang = [language] if isinstance(language, str) else []
    own = stems(notes.select("recording_id", "note_id", "text", *lang), ("note_id",)).groupBy("recording_id", "note_id", "stem").agg(F.count("*").alias("n"))
    size = own.groupBy("recording_id", "note_id").agg(F.sum("n").alias("_all")).where(F.col("_all") >= EXAMPLE_MIN_WORDS)
    ex = stems(examples.withColumn("recording_id", F.lit(0)).select("recording_id", "line_no", "text", *[F.lit("it").alias(x) for x in lang]), ("line_no",))
    ex = ex.select("line_no", "stem").distinct()
    hit = own.join(ex, "stem").groupBy("recording_id", "note_id", "line_no").agg(F.sum("n").alias("_hit"))
    copied = hit.join(size, ["recording_id", "note_id"]).where(F.col("_hit") >= EXAMPLE_SHARE * F.col("_all")).select("recording_id", "note_id").distinct()
    return notes.join(copied, ["recording_id", "note_id"], "left_anti")


def entities(notes: DataFrame, language: Column | str | None = None, k: int = 4) -> DataFrame:
    """The words each note is most about: its own that most notes of the recording use."""
    t = tm.content_terms(notes, language, ("note_no",)).distinct()
    df = t.groupBy("recording_id", "term").agg(F.count("*").alias("_df"))
    nth = F.row_number().over(Window.partitionBy("recording_id", "note_no").orderBy(F.desc("_df"), F.desc(F.length("term")), "term"))
    best = t.join(df, ["recording_id", "term"]).withColumn("_r", nth).where(F.col("_r") <= k)
    return best.groupBy("recording_id", "note_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("entities"))


def enrich_notes(notes: DataFrame) -> DataFrame:
    """Dates and figures found in each note's own text."""
    def found(pattern):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    return notes.withColumns({"dates": found(DATES), "numbers": found(NUMBERS)})


# --- passes ------------------------------------------------------------------

def _chunk_fold(budget: int, carry: float):
    """State: the open chunk's key, relative to the block, then the cost of each of its sentences.

    Costs are summed once; where a chunk ends, and from where it is carried on, are searches in the sums.
    """
    def fold(pdf: pd.DataFrame, state: list[float]):
        nos, held = pdf["sent_no"].to_numpy(), len(state) - 1
        costs = np.concatenate([np.array(state[1:], float), pdf["_cost"].to_numpy(float)])
        upto = np.append(0.0, np.cumsum(costs))
        first = int(nos[0])
        low, new, key = 0, held, int(state[0]) + first
        must, parts = held if held else 1, []
        while True:
            high = max(must, int(np.searchsorted(upto, upto[low] + budget, side="right")) - 1)
            parts.append((first - held + new, first - held + high, key, False))
            if high >= len(costs):
                break
            # Of the end of the chunk, but never all of it, what the overlap has room for.
            back = max(low + 1, int(np.searchsorted(upto, upto[high] - carry, side="left"))) if carry > 0 else high
            key = int(nos[high - held])
            parts.append((first - held + back, first - held + high, key, True))
            low, new, must = back, high, high + 1
        long = [b - a for a, b, *_ in parts]
        out = {"recording_id": pdf["recording_id"].to_numpy()[:1].repeat(sum(long)),
               "sent_no": np.concatenate([np.arange(a, b) for a, b, *_ in parts]),
               "chunk_start": np.repeat([k for *_, k, _ in parts], long),
               "carried": np.repeat([c for *_, c in parts], long)}
        return out, [float(key - int(nos[-1]) - 1), *costs[low:].tolist()]
    return fold


def chunk_sentences(sentences: DataFrame, budget: int, overlap: float = 0.0, language: Column | str | None = None) -> DataFrame:
    """Consecutive sentences in passes of at most ``budget`` tokens: ``recording_id, chunk_start, sent_no, carried``.

    ``sent_no`` is dense. A chunk is named by its first new sentence; up to ``overlap`` of the
    budget is carried from the end of the one before, never all of it.
    """
    c = sentences.select("recording_id", "sent_no", (tx.estimate_tokens(F.col("text"), language) + SENTENCE_OVERHEAD).alias("_cost"))
    out = T.StructType([c.schema["recording_id"], T.StructField("sent_no", T.LongType()),
                        T.StructField("chunk_start", T.LongType()), T.StructField("carried", T.BooleanType())])
    fold = _chunk_fold(budget, max(0.0, min(0.5, overlap)) * budget)

    return fold_blocks(c, ["recording_id"], "sent_no", fold, out, [0.0])


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where("not carried").groupBy("recording_id").agg(F.count_distinct("chunk_start").alias("chunks"))


def cut_to_fit(sentences: DataFrame, scores: DataFrame, budget: int, max_passes: int, overlap: float = 0.0,
               language: Column | str | None = None, tries: int = 3) -> DataFrame:
    """Sentences selected down until every recording fits its passes, in at most ``tries`` rounds.

    Recordings that fit leave the rounds; the others aim lower by how far they missed.
    """
    from colloquy.operators.summarise import reduce_to_budget
    aim = sentences.select("recording_id").distinct().withColumn("budget", F.lit(budget * max_passes).cast("long"))
    todo, done = sentences, None
    for turn in range(tries):
        kept = materialise(reduce_to_budget(todo, scores, aim, language))
        renumbered = in_order(kept, ["recording_id"], ["sent_no"], sums={"_n": F.lit(1)}).withColumn("_n", F.col("_n") - 1)
        n = materialise(chunk_counts(chunk_sentences(renumbered.drop("sent_no").withColumnRenamed("_n", "sent_no"), budget, overlap, language)))
        over = n.where(F.col("chunks") > max_passes)
        if turn == tries - 1 or over.isEmpty():
            return kept if done is None else done.unionByName(kept)
        fits = kept.join(over, "recording_id", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        aim = materialise(aim.join(over, "recording_id").select(
            "recording_id", F.floor(F.col("budget") * max_passes / F.col("chunks")).cast("long").alias("budget")))
        todo = todo.join(over, "recording_id", "left_semi")
    return done


def fold_tree(partials: DataFrame, fanin: int = 6, max_depth: int = 3, max_fanin: int | None = None) -> DataFrame:
    """Which partials each folding pass takes: ``recording_id, level, group_no, member``.

    ``partials(recording_id, idx)``, ``idx`` dense from 0. Members above the first level are
    the groups below. The fan-in widens until the depth allowed is enough, up to ``max_fanin``.
    """
    levels_allowed = max(1, max_depth - 1)
    n = partials.groupBy("recording_id").agg((F.max("idx") + 1).alias("_n"))
    root = F.ceil(F.pow(F.col("_n").cast("double"), F.lit(1.0 / levels_allowed)) - 1e-9)
    width = F.greatest(F.lit(max(2, fanin)), root)
    if max_fanin:
        width = F.least(width, F.lit(max(2, fanin, max_fanin)))
    n = materialise(n.withColumn("_w", width.cast("long")))
    level = partials.select("recording_id", "idx").join(n, "recording_id")
    out, deepest, at = None, n.agg(F.max(F.col("_n")), F.min("_w")).first(), 1
    most = deepest[0] or 0
    while True:
        g = level.withColumn("group_no", F.floor(F.col("idx") / F.col("_w")))
        rows = g.select("recording_id", F.lit(at).alias("level"), "group_no", F.col("idx").alias("member"))
        out = rows if out is None else out.unionByName(rows)
        most = -(-most // deepest[1]) if deepest[1] else 0
        if most <= 1:
            return out
        level = (g.where(F.col("_n") > F.col("_w")).select("recording_id", F.col("group_no").alias("idx"), "_n", "_w").distinct()
                 .withColumn("_n", F.ceil(F.col("_n") / F.col("_w"))))
        at += 1


# --- whole pages in one answer -----------------------------------------------

FIELDS = ["abstract", "points", "decisions", "actions", "keywords"]


def _field_of(heading: Column, language: str) -> Column:
    key = tx.strip(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N}_\s]", ""))
    out = F.lit(None).cast("string")
    for lang in ("en", language):
        for field in FIELDS:
            out = F.when(key == lx.PAGE_WORDS[lang][field].lower(), F.lit(field)).otherwise(out)
    return out


def parse_sections(answers: DataFrame, language: str = "it", scaffold: list[str] | None = None) -> DataFrame:
    """A page written in one answer as rows: ``recording_id, chunk_idx, field, line_no, text, start_ms, speaker``.

    Lines of the instructions (``scaffold``) are no content. An answer with no heading of
    ours is an abstract as it stands.
    """
    lines = _lines(clean_answers(answers.withColumn("prompt", answers["prompt"] if "prompt" in answers.columns else F.lit(None).cast("string"))), ANSWER)
    head = F.col("line").rlike(PAGE_HEADING)
    label_field = _field_of(F.regexp_extract("line", LABELLED, 1), language)
    labelled = ~head & F.col("line").rlike(LABELLED) & label_field.isNotNull()
    named = F.when(head, F.coalesce(_field_of(_group(F.col("line"), PAGE_HEADING, 4), language), F.lit(""))).when(labelled, label_field)
    w = Window.partitionBy(*ANSWER)         # one answer, bounded by its token budget
    run = w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = lines.withColumns({"_head": head, "_lab": labelled, "_named": named})
    x = x.withColumns({"field": F.last("_named", ignorenulls=True).over(run),
                       "_matched": F.max(F.coalesce(F.col("_named") != "", F.lit(False))).over(w)})
    bullet = F.col("line").rlike(BULLET)
    content = F.when(F.col("_lab"), F.trim(F.regexp_extract("line", LABELLED, 2))).when(bullet, F.regexp_extract("line", BULLET, 1)).otherwise(F.trim("line"))
    x = x.withColumn("text", content)
    body = x.where(F.col("_matched") & ~F.col("_head") & (F.trim("line") != "") & (F.coalesce("field", F.lit("")) != "")
                   & (F.col("_lab") | bullet | (F.col("field") == "abstract")) & (F.col("text") != ""))
    if scaffold:
        body = body.where(~F.col("text").isin(*scaffold))
    words = body.where("field = 'keywords'").select(*ANSWER, "field", "line_no", F.explode(F.split("text", ",")).alias("text"))
    words = words.withColumn("text", F.trim("text")).where("text <> ''")
    whole = x.where(~F.col("_matched") & (F.trim("line") != "")).select(*ANSWER, F.lit("abstract").alias("field"), "line_no", F.col("line").alias("text"))
    pts = body.where("field <> 'keywords'").select(*ANSWER, "field", "line_no", "text").unionByName(words).unionByName(whole)
    is_point = F.col("field").isin("points", "decisions", "actions")
    stamp = F.when(is_point, F.regexp_extract("text", POINT_CLOCK, 1))
    pts = pts.withColumn("start_ms", F.when(stamp != "", clock.clock_ms(stamp))).withColumn(
        "text", F.when(is_point, F.regexp_replace("text", POINT_CLOCK, "")).otherwise(F.col("text")))
    who = F.when(is_point, F.nullif(F.trim(F.regexp_extract("text", POINT_SPEAKER, 1)), F.lit("")))
    return pts.withColumn("speaker", who).withColumn("text", F.trim(F.when(is_point, F.regexp_replace("text", POINT_SPEAKER, "")).otherwise(F.col("text"))))
