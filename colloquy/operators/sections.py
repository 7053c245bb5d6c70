"""Notes to sections: duplicates dropped, subjects discovered or kinds routed, titles and checks."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions import lexicons as lx
from colloquy.functions import text as tx
from colloquy.operators import terms as tm
from colloquy.operators.notes import BULLET
from colloquy.operators.summarise import by_recording
from colloquy.plans.ordered import dense
from colloquy.plans.store import materialise

# --- fixed values: what makes a section --------------------------------------
SAME_NOTE, ALIKE, QUOTED = 0.80, 0.5, 0.85
TIGHTEST, STEP, STEPS = 0.55, 0.02, 23
MAX_SECTIONS, MIN_NOTES, STRAY_SHARE, ORPHANED = 12, 2, 0.20, 0.97
MOST_NOTES, TIGHT_AGAIN = 24, 0.60
OTHER = {"it": "Altri punti", "en": "Other points"}
UNTITLED = {"it": "Riassunto della registrazione", "en": "Summary of the recording"}
FINDING = (r"(?i)^\s*(?:(?:[-*•]|\d{1,2}[.)])\s*)?\**\s*(INVENTATA|DOPPIA|SCORRETTA|INVENTED|REPEATED|GARBLED)"
           r"\s*\**\s*[:\-–—]\s*(.+?)\s*$")
FINDING_KINDS = {"inventata": "unsupported", "invented": "unsupported", "doppia": "repeated",
                 "repeated": "repeated", "scorretta": "garbled", "garbled": "garbled"}
_QUOTES = " \t\"'«»“”*.;:"
_MARKER = r"^\s*(?:[-*•]|\d{1,2}[.)])\s+"

NOTE = ["recording_id", "note_no"]


def dedupe_notes(notes: DataFrame, weighted: DataFrame, same: float = SAME_NOTE) -> DataFrame:
    """Notes told twice kept once: the fuller telling, the earlier minute.

    ``weighted`` are the notes' term weights by ``note_no``. A note's place is its leader's.
    """
    led = tm.greedy_leaders(weighted, same, ("note_no",)).select(
        "recording_id", F.col("id.note_no").alias("note_no"), F.col("leader.note_no").alias("_lead"))
    n = notes.join(led, NOTE, "left").withColumn("_lead", F.coalesce("_lead", "note_no"))
    cols = [c for c in notes.columns if c not in ("recording_id", "ts_start_ms")]
    g = n.groupBy("recording_id", "_lead").agg(
        F.max_by(F.struct(*cols), F.struct(F.length("text"), -F.col("note_no"))).alias("b"), F.min("ts_start_ms").alias("ts_start_ms"))
    return g.select("recording_id", *[F.col("_lead").alias("note_no") if c == "note_no" else F.col("b")[c].alias(c) for c in cols], "ts_start_ms")


def _distances(apart: float | None) -> list[float]:
    return [apart] if apart is not None else [round(TIGHTEST + STEP * i, 2) for i in range(STEPS)]


def _labels(vectors: np.ndarray, least: list[float]) -> np.ndarray:
    """Each note's cluster, named by its first note, at each of the ``least`` likenesses.

    Clusters that are each other's nearest merge, all at once, until none is near enough. Of equally near ones the first
    counts; likenesses are equal to nine digits.
    """
    sums, size, open_ = vectors.copy(), np.ones(len(vectors)), np.arange(len(vectors))
    label = np.tile(open_, (len(least), 1))
    while len(open_) > 1:
        like = np.round(sums[open_] @ sums[open_].T / np.outer(size[open_], size[open_]), 9)
        np.fill_diagonal(like, -1.0)
        near = like.argmax(axis=1)
        top = like[np.arange(len(open_)), near]
        first = np.flatnonzero((near[near] == np.arange(len(open_))) & (np.arange(len(open_)) < near) & (top >= min(least)) & (top > 0))
        if not len(first):
            break
        for i in first:
            keep, gone = open_[i], open_[near[i]]
            sums[keep] += sums[gone]
            size[keep] += size[gone]
            for t in np.flatnonzero(top[i] >= np.array(least)):
                label[t][label[t] == gone] = keep
        open_ = np.delete(open_, near[first])
    return label


def _labels_in_task(least: list[float], out: T.StructType):
    shape = to_arrow_schema(out)

    def run(rows: pa.Table) -> pa.Table:
        ids = np.unique(rows["note_no"].to_numpy())
        said = rows.filter(pc.is_valid(rows["term"]))
        names, code = np.unique(said["term"].to_numpy(), return_inverse=True)
        m = np.zeros((len(ids), max(1, len(names))))
        m[np.searchsorted(ids, said["note_no"].to_numpy()), code] = said["w"].to_numpy()
        found = _labels(m, least)
        return pa.table([pa.array([rows["recording_id"][0].as_py()] * found.size, shape.field(0).type), pa.array(np.tile(ids, len(least)), pa.int64()),
                         pa.array(ids[found.ravel()], pa.int64()), pa.array(np.repeat(np.arange(len(least)), len(ids)), pa.int64())], schema=shape)
    return run


def _labels_as_joins(notes: DataFrame, weighted: DataFrame, distances: list[float]) -> DataFrame:
    """The same merges as joins and sums, for recordings too big for a task.

    A cluster is the sum of its notes' vectors, so only clusters sharing a word ever meet. Each note keeps
    its label at every distance tried.
    """
    key = ["recording_id"]
    words = materialise(weighted.select(*key, F.col("note_no").alias("c"), "term", F.col("w").alias("s")))
    size = materialise(notes.select(*key, F.col("note_no").alias("c"), F.lit(1).cast("long").alias("n")))
    at = F.posexplode(F.array(*[F.lit(1.0 - d) for d in distances])).alias("t", "least")
    label = materialise(notes.select(*key, "note_no", F.col("note_no").alias("section"), at))
    found = words
    while True:
        one = found.join(size, [*key, "c"])
        two = one.select(*key, "term", F.col("c").alias("d"), F.col("s").alias("s2"), F.col("n").alias("n2"))
        like = (one.join(two, [*key, "term"]).where("c < d").groupBy(*key, "c", "d")
                .agg(F.round(F.sum(F.col("s") * F.col("s2")) / F.max(F.col("n") * F.col("n2")), 9).alias("like"))
                .where((F.col("like") >= 1.0 - distances[-1]) & (F.col("like") > 0)))
        like = materialise(like)
        ends = like.select(*key, F.col("c").alias("me"), F.col("d").alias("it"), "like").unionByName(
            like.select(*key, F.col("d").alias("me"), F.col("c").alias("it"), "like"))
        best = ends.groupBy(*key, "me").agg(F.max(F.struct("like", (-F.least("me", "it")).alias("x"), (-F.greatest("me", "it")).alias("y"))).alias("b"))
        pair = best.select(*key, (-F.col("b.x")).alias("keep"), (-F.col("b.y")).alias("gone"), F.col("b.like").alias("like"))
        merges = materialise(pair.groupBy(*key, "keep", "gone", "like").agg(F.count("*").alias("_k")).where("_k = 2").drop("_k"))
        if merges.isEmpty():
            break
        into = merges.select(*key, F.col("gone").alias("c"), "keep")

        def moved(df):
            return df.join(into, [*key, "c"], "left").withColumn("c", F.coalesce("keep", "c"))       # noqa: B023
        found = materialise(moved(found).groupBy(*key, "c", "term").agg(F.sum("s").alias("s")))
        size = materialise(moved(size).groupBy(*key, "c").agg(F.sum("n").alias("n")))
        named = merges.select(*key, F.col("gone").alias("section"), "keep", "like")
        label = materialise(label.join(named, [*key, "section"], "left").withColumn(
            "section", F.when(F.col("like") >= F.col("least"), F.col("keep")).otherwise(F.col("section"))).drop("keep", "like"))
    return label.select(*key, "note_no", "section", "t")


def _settle(label: DataFrame, weighted: DataFrame, most: int) -> DataFrame:
    """Of the distances tried the first that gives few enough sections and strays (else the last), and strays adopted.

    Every stray is compared with the sections as found, whatever else was adopted.
    """
    key = ["recording_id"]
    words = weighted.select(*key, "note_no", "term", F.col("w").alias("s"))
    groups = label.groupBy(*key, "t", "section").agg(F.count("*").alias("n"))
    shape = groups.groupBy(*key, "t").agg(F.count_if(F.col("n") >= MIN_NOTES).alias("k"), F.sum(F.when(F.col("n") < MIN_NOTES, 1).otherwise(0)).alias("alone"), F.sum("n").alias("all"))
    good = (F.col("k") > 0) & (F.col("k") <= most) & (F.col("alone") <= STRAY_SHARE * F.col("all"))
    chosen = shape.groupBy(*key).agg(F.coalesce(F.min(F.when(good, F.col("t"))), F.max("t")).alias("t"))
    mine = materialise(label.join(chosen, [*key, "t"]).join(groups, [*key, "t", "section"]).select(*key, "note_no", "section", "n"))
    settled = mine.where(F.col("n") >= MIN_NOTES)
    sums = (words.join(settled, [*key, "note_no"]).groupBy(*key, "section", "term")
            .agg((F.sum("s") / F.max("n")).alias("m")))
    stray = mine.where(F.col("n") < MIN_NOTES).select(*key, "note_no")
    near = (words.join(stray, [*key, "note_no"]).join(sums, [*key, "term"])
            .groupBy(*key, "note_no", "section").agg(F.round(F.sum(F.col("s") * F.col("m")), 9).alias("like")))
    home = near.where(F.col("like") >= 1.0 - ORPHANED).groupBy(*key, "note_no").agg(F.max_by("section", F.struct("like", -F.col("section"))).alias("section"))
    lone = stray.join(home, [*key, "note_no"], "left").withColumn("section", F.coalesce("section", F.lit(-1)))
    return settled.select(*key, "note_no", "section").unionByName(lone.select(*key, "note_no", "section"))


#: Notes of one recording that are grouped inside a task, and rows that a note is worth there, about.
TASK_NOTES, NOTE_WORDS = 2000, 12


def discover_sections(notes: DataFrame, weighted: DataFrame, apart: float | None = None, most: int = MAX_SECTIONS,
                      task_notes: int = TASK_NOTES) -> DataFrame:
    """The section each note falls in by likeness: ``recording_id, note_no, section``, -1 for none.

    A section is named by its first note. Recordings of up to ``task_notes`` notes are merged
    inside a task each, larger ones by joins over the cluster; the result is the same.
    """
    distances = _distances(apart)
    out = T.StructType([notes.schema["recording_id"], *(T.StructField(c, T.LongType()) for c in ("note_no", "section", "t"))])
    size = materialise(notes.groupBy("recording_id").agg(F.count("*").alias("_n")))
    big = materialise(size.where(F.col("_n") > task_notes).select("recording_id"))
    # A note's words are a dozen, about: some thousands of notes share a call, and terms go as numbers.
    many = (size.agg(F.sum("_n")).first()[0] or 0) * NOTE_WORDS
    rows = notes.select(*NOTE).join(tm.coded(weighted.select(*NOTE, "term", "w")), NOTE, "left")
    label = by_recording(rows.join(big, "recording_id", "left_anti"), many, _labels_in_task([1.0 - d for d in distances], out), out)
    if not big.isEmpty():
        label = label.unionByName(_labels_as_joins(notes.join(big, "recording_id", "left_semi"), weighted.join(big, "recording_id", "left_semi"), distances))
    return _settle(materialise(label), weighted, most)


def section_keywords(placed: DataFrame, language: Column | str | None = None, k: int = 3) -> DataFrame:
    """The terms most notes of a section share. ``placed``: notes with ``section``."""
    t = tm.content_terms(placed, language, ("section", "note_no")).distinct()
    c = t.groupBy("recording_id", "section", "term").agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy("recording_id", "section").orderBy(F.desc("_n"), F.desc(F.length("term")), "term"))
    return c.withColumn("_r", nth).where(F.col("_r") <= k).groupBy("recording_id", "section").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("keywords"))


def route_sections(notes: DataFrame, kinds: list[str] | None = None, keep_rest: bool = True) -> DataFrame:
    """One section per kind, in the order of ``kinds``; what is left under ``other``.

    ``recording_id, note_no, section, kind``, ``section`` being the kind's place.
    """
    wanted = kinds or [k for k, _, _ in lx.NOTE_KINDS]
    place = F.lit(None).cast("long")
    for i, k in enumerate(wanted):
        place = F.when(F.col("type") == k, F.lit(i).cast("long")).otherwise(place)
    r = notes.select(*NOTE, "type", place.alias("section"))
    r = r.withColumns({"kind": F.when(F.col("section").isNotNull(), F.col("type")).otherwise("other"),
                       "section": F.coalesce("section", F.lit(len(wanted)).cast("long"))})
    return (r if keep_rest else r.where("kind <> 'other'")).drop("type")


def assign_sections(notes: DataFrame, weighted: DataFrame | None = None, mode: str = "hybrid", kinds: list[str] | None = None,
                    tail_kinds: list[str] | None = None) -> DataFrame:
    """Every note's section: ``recording_id, note_no, part, origin, section, kind``.

    ``fixed`` routes by kind; ``discover`` groups by likeness; ``hybrid`` does that and repeats
    decisions and actions in a ``tail``.
    """
    if mode == "fixed":
        return route_sections(notes, kinds).withColumns({"part": F.lit("body"), "origin": F.lit("routed")})
    if mode not in ("discover", "hybrid"):
        raise ValueError(f"unknown way of making sections: {mode}")
    found = discover_sections(notes, weighted)
    body = found.withColumns({"part": F.lit("body"), "origin": F.lit("discovered"), "kind": F.when(F.col("section") < 0, "other")})
    repeated = lx.TAIL_KINDS if tail_kinds is None else tail_kinds
    if mode == "discover" or not repeated:
        return body
    tail = route_sections(notes.where(F.col("type").isin(*repeated)), repeated, keep_rest=False)
    return body.unionByName(tail.withColumns({"part": F.lit("tail"), "origin": F.lit("routed")}))


def split_oversize(placed: DataFrame, language: Column | str | None = None, most: int = MOST_NOTES) -> DataFrame:
    """Sections of more than ``most`` notes in several: by subject where that is enough, else in runs.

    ``placed``: notes with ``section``; adds ``piece``. Notes near no piece make a last one.
    """
    size = placed.groupBy("recording_id", "section").agg(F.count("*").alias("_n"))
    p = placed.join(size, ["recording_id", "section"])
    small = p.where(F.col("_n") <= most).withColumn("piece", F.lit(0).cast("long"))
    big = materialise(p.where(F.col("_n") > most).withColumn("_rec", F.col("recording_id")).withColumn(
        "recording_id", F.concat_ws("/", "recording_id", "section")))
    if big.isEmpty():
        return small.drop("_n")
    w = materialise(tm.weights(big, language, ("note_no",)))
    again = materialise(discover_sections(big, w, apart=TIGHT_AGAIN, most=1 << 30))
    widest = again.groupBy("recording_id", "section").agg(F.count("*").alias("_c")).groupBy("recording_id").agg(
        F.max("_c").alias("_widest"), F.max("section").alias("_any"))
    # A section may be most of a corpus: its notes are numbered in blocks.
    runs = F.floor(F.col("_nth") / most)
    big = (dense(big, ["recording_id"], ["note_no"], "_nth").join(again.withColumnRenamed("section", "_piece"), NOTE).join(widest, "recording_id")
           .withColumn("_run", runs).withColumn("piece", F.when((F.col("_any") < 0) | (F.col("_widest") > most), F.col("_run"))
                                                .otherwise(F.when(F.col("_piece") < 0, 1 << 40).otherwise(F.col("_piece"))).cast("long"))
           .withColumn("recording_id", F.col("_rec")).drop("_rec", "_piece", "_widest", "_any", "_run", "_nth"))
    return small.unionByName(big.select(*small.columns)).drop("_n")


def section_table(placed: DataFrame) -> DataFrame:
    """Sections in the order the recording had them: ``section_no``, ``ts_min_ms``, ``notes``."""
    g = placed.groupBy("recording_id", "section").agg(
        F.coalesce(F.min("ts_start_ms"), F.lit(0)).alias("ts_min_ms"), F.count("*").alias("notes"))
    stray = F.when(F.col("section") < 0, 1).otherwise(0)
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(stray, "ts_min_ms", "section"))
    return g.withColumn("section_no", nth.cast("long"))


def section_shape(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Sections, tail, orphans and notes dropped as repeats, per recording. ``placed`` has ``part``, ``kind``."""
    body, tail = F.col("part") == "body", F.col("part") == "tail"
    per = placed.groupBy("recording_id", "part", "section").agg(F.count("*").alias("_n"), F.max("kind").alias("kind"))
    s = per.groupBy("recording_id").agg(
        F.count_if(body).alias("sections"), F.sum(F.when(body, F.col("_n")).otherwise(0)).alias("sections_kept"),
        F.sort_array(F.collect_list(F.when(body, F.col("_n")))).alias("section_sizes"),
        F.sort_array(F.collect_list(F.when(tail, F.col("_n")))).alias("tail_sizes"),
        F.sum(F.when(body & (F.col("kind") == "other"), F.col("_n")).otherwise(0)).alias("orphans"))
    n = found.groupBy("recording_id").agg(F.count("*").alias("_found"))
    return n.join(s, "recording_id", "left").withColumn("notes_deduped", F.col("_found") - F.col("sections_kept")).drop("_found")


def label_sections(sections: DataFrame, kinds: DataFrame, language: str = "it") -> DataFrame:
    """A heading per section: its kind's, the one for leftovers, a model's ``written``, else its keywords."""
    heads = kinds.where(F.col("language") == language).select(F.col("name").alias("kind"), F.col("heading").alias("_h"))
    s = sections.join(heads, "kind", "left")
    first = F.element_at("keywords", 1)
    spelled = F.concat(tx.capital(F.substring(first, 1, 1)), F.lower(F.expr("substring(element_at(keywords, 1), 2)")))
    named = F.when(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0,
                   F.array_join(F.concat(F.array(spelled), F.slice("keywords", 2, 2)), ", "))
    written = F.nullif(F.trim(F.coalesce("written", F.lit(""))), F.lit("")) if "written" in sections.columns else F.lit(None).cast("string")
    other = F.when(F.col("kind") == "other", F.lit(OTHER[language]))
    catalogue = F.coalesce(F.col("_h"), other)
    return s.withColumns({"title": F.coalesce(catalogue, written, named, F.lit(OTHER[language])),
                          "named_by": F.when(catalogue.isNotNull(), "catalogue").when(written.isNotNull(), "model").otherwise("keywords")}).drop("_h")


def document_title(labelled: DataFrame, recordings: DataFrame, language: str = "it") -> DataFrame:
    """The first one or two titles a model wrote; else the recording's own; else a plain one.

    ``labelled`` needs ``section_no``; ``recordings(recording_id, title)``.
    """
    real = labelled.where((F.col("named_by") == "model") & (F.col("title") != OTHER[language]))
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("section_no"))
    top = real.withColumn("_r", nth).where(F.col("_r") <= 3).groupBy("recording_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("_t"))
    more = F.lit({"it": " e altro", "en": " and more"}[language])
    both = F.concat(F.get("_t", 0), F.lit(", "), F.lower(F.get("_t", 1)), F.when(F.size("_t") > 2, more).otherwise(F.lit("")))
    j = recordings.select("recording_id", F.col("title").alias("_own")).join(top, "recording_id", "left")
    title = F.when(F.size("_t") >= 2, both).when(F.size("_t") == 1, F.get("_t", 0))
    return j.select("recording_id", F.coalesce(title, F.nullif(F.coalesce("_own", F.lit("")), F.lit("")), F.lit(UNTITLED[language])).alias("title"))


def page_lines(written: DataFrame) -> DataFrame:
    """The lines of written sections: ``written(recording_id, section_no, body)``."""
    return written.select("recording_id", "section_no", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))


def trim_repeated_bullets(written: DataFrame, language: Column | str | None = None, same: float = SAME_NOTE) -> DataFrame:
    """The sections' lines without a bullet that an earlier one of the page already says."""
    lines = materialise(page_lines(written).withColumn("text", F.regexp_replace("line", _MARKER, "")))
    ids = ("section_no", "line_no")
    lang = F.lit(language) if isinstance(language, str) else language
    w = materialise(tm.weights(lines.where(F.col("line").rlike(_MARKER)), lang, ids))
    gone = tm.greedy_leaders(w, same, ids).select("recording_id", *[F.col("id")[i].alias(i) for i in ids])
    return lines.join(gone, ["recording_id", *ids], "left_anti").select("recording_id", *ids, "line")


# --- what a reviewer says ----------------------------------------------------

def _compared(c: Column) -> Column:
    return F.lower(tx.collapse(F.btrim(F.regexp_replace(c, _MARKER, ""), F.lit(_QUOTES))))


@F.pandas_udf(T.DoubleType())
def line_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _letters_in_common(a: Column, b: Column) -> Column:
    """Letters that two texts share, each as often as both have it: at least what any alignment of them can match."""
    def times(c, x):
        return F.length(c) - F.length(F.replace(c, x, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.least(times(a, x), times(b, x))))


def review_findings(answers: DataFrame, written: DataFrame, language: Column | str | None = None) -> DataFrame:
    """What a model reading the page back found, as far as it can be believed.

    ``answers(recording_id, section_no, answer)`` hold one finding a line, ``written`` the
    sections. A finding must quote a line that is there; a repeat must have a line like it; a
    line called wrong in two ways, and a section flagged for more than half, are dropped.
    """
    key = ["recording_id", "section_no"]
    said = answers.select(*key, F.posexplode(F.split("answer", r"\R")).alias("_f", "row")).where(F.col("row").rlike(FINDING))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in FINDING_KINDS.items() for x in kv]), F.lower(F.regexp_extract("row", FINDING, 1)))
    said = said.select(*key, "_f", kind.alias("kind"), F.regexp_extract("row", FINDING, 2).alias("quoted"))
    said = said.withColumn("_q", _compared(F.col("quoted"))).where(F.length("_q") >= 8)
    lines = materialise(page_lines(written).where(F.trim("line") != "").withColumn("_p", _compared(F.col("line"))))
    # Findings meet only the lines of their own section.
    met = said.join(lines.where("_p <> ''"), key)
    within = F.contains("_p", F.col("_q"))
    wrapped = F.contains("_q", F.col("_p")) & (F.length("_p") >= 0.6 * F.length("_q"))
    told = met.withColumn("_like", F.when(within, 2.0).when(wrapped, 1.0))
    # Twice the letters in common over all letters: too few where the lengths differ much, or where few letters are the same.
    both = F.length("_q") + F.length("_p")
    able = (F.least(F.length("_q"), F.length("_p")) * 2 >= QUOTED * both) & (_letters_in_common(F.col("_q"), F.col("_p")) * 2 >= QUOTED * both)
    rest = told.where(F.col("_like").isNull() & able).withColumn("_like", line_likeness("_q", "_p")).where(F.col("_like") >= QUOTED)
    met = told.where("_like is not null").unionByName(rest)
    first = met.groupBy(*key, "_f", "kind", "quoted").agg(F.max_by(F.struct("line_no", "line", "_like"), F.struct("_like", -F.col("line_no"))).alias("m"))
    own = F.btrim(F.regexp_replace("quoted", _MARKER, ""), F.lit(" \t\"'«»“”*"))
    f = first.select(*key, "kind", F.col("m.line_no").alias("line_no"), F.when(F.col("m._like") == 2.0, own).otherwise(
        F.trim(F.regexp_replace("m.line", _MARKER, ""))).alias("line")).distinct()
    # A twin is measured among the lines of the same section.
    keyed = lines.select(F.concat_ws("/", *key).alias("recording_id"), "line_no", F.regexp_replace("line", _MARKER, "").alias("text"))
    pairs = tm.similar_pairs(tm.weights(keyed, F.lit(language) if isinstance(language, str) else language, ("line_no",)), ALIKE, ("line_no",))
    twins = pairs.select("recording_id", F.col("a.line_no").alias("line_no")).unionByName(
        pairs.select("recording_id", F.col("b.line_no").alias("line_no"))).distinct().withColumnRenamed("recording_id", "_k")
    f = f.withColumn("_k", F.concat_ws("/", *key)).join(twins.withColumn("_twin", F.lit(True)), ["_k", "line_no"], "left")
    f = materialise(f.where((F.col("kind") != "repeated") | F.col("_twin")).select(*key, "line_no", "line", "kind"))
    clear = f.groupBy(*key, "line_no", "line").agg(F.max("kind").alias("kind"), F.count_distinct("kind").alias("_k")).where("_k = 1").drop("_k")
    size = lines.groupBy(*key).agg(F.count("*").alias("_lines"))
    flagged = clear.groupBy(*key).agg(F.count_distinct("line").alias("_flagged"))
    fair = flagged.join(size, key).where(~((F.col("_flagged") > 1) & (F.col("_flagged") * 2 > F.col("_lines"))))
    return clear.join(fair, key, "left_semi").select(*key, "line", "kind")
