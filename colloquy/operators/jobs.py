"""Whole jobs, composed from the operators: one lazy plan each, cut where several steps read the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import callouts as co
from colloquy.operators import layout as lo
from colloquy.operators import notes as no
from colloquy.operators import sections as se
from colloquy.operators import speakers as sp
from colloquy.operators import terms as tm
from colloquy.plans.ordered import in_order
from colloquy.plans.store import materialise

LineSource = Callable[[], Callable[[str], str]]


def read_with_speakers(segments: DataFrame, turns: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The dialogue: segments given speakers, renamed where asked, merged into turns."""
    s = sp.assign_speakers(segments, turns)
    if names is not None:
        s = sp.rename_speakers(s, names)
    return lo.dialogue(materialise(s))


def read_without_speakers(segments: DataFrame, prose: DataFrame) -> DataFrame:
    """Paragraphs of every recording: by pauses where it has times, five sentences each where not."""
    timed = lo.paragraphs(segments).select("recording_id", "para_no", "text")
    return timed.unionByName(lo.paragraphs_of_prose(lo.untimed(prose, segments)))


def read_passes(sentences: DataFrame, budget: int, open_client: LineSource, overlap: float = 0.0,
                language: Column | str | None = None) -> DataFrame:
    """A model's answer to each pass over the sentences, cleaned of echoes.

    ``sentences(recording_id, sent_no, text, start_ms, end_ms, speaker)``. A pass holds at
    most ``budget`` tokens, so its prompt is one short text.
    """
    chunks = materialise(no.chunk_sentences(sentences, budget, overlap, language))
    s = chunks.join(sentences, ["recording_id", "sent_no"]).withColumnRenamed("chunk_start", "chunk_idx")
    s = materialise(s)
    lines = lo.prompt_text(s, "sent_no", ["recording_id", "chunk_idx"])
    prompts = lines.groupBy("recording_id", "chunk_idx").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("sent_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    spans = s.groupBy("recording_id", "chunk_idx").agg(F.min("start_ms").alias("span_start_ms"), F.max("end_ms").alias("span_end_ms"))
    asked = prompts.join(spans, ["recording_id", "chunk_idx"])
    answered = materialise(co.map_text(asked, open_client).withColumnRenamed("text", "prompt"))     # a model is asked once
    return no.clean_answers(answered)


def summarise_sections(answers: DataFrame, kinds: DataFrame, language: str = "it", mode: str = "hybrid",
                       examples: DataFrame | None = None) -> DataFrame:
    """Answers to placed notes: parsed, copies and repeats dropped, enriched, grouped, split.

    ``recording_id, part, section, piece, kind, note_no, type, text, ts_start_ms, entities, dates, numbers``.
    """
    n = materialise(no.number_notes(no.parse_notes(answers, kinds, language)))
    if examples is not None:
        n = materialise(no.drop_example_copies(n, examples))
    lang = F.lit(language)
    n = materialise(se.dedupe_notes(n, tm.weights(n, lang, ("note_no",))))
    n = materialise(no.enrich_notes(n).join(no.entities(n, lang), ["recording_id", "note_no"], "left"))
    placed = materialise(se.assign_sections(n, materialise(tm.weights(n, lang, ("note_no",))), mode).join(n, ["recording_id", "note_no"]))
    body = se.split_oversize(placed.where("part = 'body'"), lang)
    tail = placed.where("part = 'tail'").withColumn("piece", F.lit(0).cast("long"))
    return body.unionByName(tail.select(*body.columns)).select(
        "recording_id", "part", "section", "piece", "kind", "note_no", "type", "text", "ts_start_ms", "entities", "dates", "numbers")


SECTION = ["recording_id", "section_no"]


def _joined(df: DataFrame, keys: list[str], order: list[str], text: Column, name: str) -> DataFrame:
    """``text`` of each group's rows in order, a line each."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_x")))), lambda x: x["_x"]), "\n").alias(name))


def write_sections(placed: DataFrame, kinds: DataFrame, recordings: DataFrame, open_writer: LineSource, open_reviewer: LineSource | None = None,
                   language: str = "it") -> tuple[DataFrame, DataFrame]:
    """The page of each recording from its placed notes (see :func:`summarise_sections`), and what was measured of it.

    Each section is written from its own notes, of which ``split_oversize`` leaves a few dozen at most, so no prompt grows with the
    recording. Bullets that an earlier section says are taken out, a reviewer's findings are kept as far as they can be
    believed, and the titles make the abstract. ``recordings(recording_id, title)`` name the page where no section does.

    The page comes as rows, ``recording_id, part, place, title, text``: ``title``, ``abstract``, ``section``, the kinds of the tail, and
    ``review``. Measures: ``recording_id, sections, bullets_repeated, findings``; :func:`measure_sections` gives them without the page.
    """
    labelled, written, kept, bodies, findings = _written(placed, kinds, open_writer, open_reviewer, language)
    titles = _joined(labelled, ["recording_id"], ["section_no"], F.col("title"), "text")
    opening = co.map_text(titles, open_writer)

    def part(df, name, place, title, text):
        return df.select("recording_id", F.lit(name).alias("part") if isinstance(name, str) else name.alias("part"), place.cast("long").alias("place"), title.alias("title"), text.alias("text"))

    none = F.lit(None).cast("string")
    page = part(se.document_title(labelled, recordings, language).join(bodies.select("recording_id").distinct(), "recording_id"), "title", F.lit(0), F.col("title"), none)
    page = page.unionByName(part(opening, "abstract", F.lit(0), none, F.col("answer")))
    page = page.unionByName(part(written.select(*SECTION, "title").join(bodies, SECTION), "section", F.col("section_no"), F.col("title"), F.col("body")))
    tail = in_order(placed.where("part = 'tail'"), ["recording_id", "kind"], ["note_no"], sums={"place": F.lit(1)})
    page = page.unionByName(part(tail, F.col("kind"), F.col("place"), none, F.col("text")))
    if findings is not None:
        # Findings are few a section.
        at = F.row_number().over(Window.partitionBy(*SECTION).orderBy("line", "kind"))
        page = page.unionByName(part(findings, "review", F.col("section_no") * 1000 + at, F.col("kind"), F.col("line")))
    return materialise(page), _measured(labelled, written, kept, findings)


def measure_sections(placed: DataFrame, kinds: DataFrame, open_writer: LineSource, open_reviewer: LineSource | None = None, language: str = "it") -> DataFrame:
    """The measures of :func:`write_sections` alone: sections are written and reviewed, no page is put together."""
    labelled, written, kept, _, findings = _written(placed, kinds, open_writer, open_reviewer, language)
    return _measured(labelled, written, kept, findings)


def _written(placed: DataFrame, kinds: DataFrame, open_writer: LineSource, open_reviewer: LineSource | None,
             language: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Sections with their titles, as written, the lines kept, the bodies of these, and what a reviewer found."""
    body = placed.where("part = 'body'")
    start = F.coalesce("ts_start_ms", F.lit(0))
    pieces = body.groupBy("recording_id", "section", "piece").agg(F.min(start).alias("ts_min_ms"), F.max("kind").alias("kind"))
    # A recording has a row a piece here, of some dozen notes each; what belongs nowhere comes last.
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.col("section") < 0, "ts_min_ms", "section", "piece"))
    numbered = materialise(body.drop("kind").join(pieces.withColumn("section_no", nth.cast("long")), ["recording_id", "section", "piece"]))
    words = se.section_keywords(numbered.select("recording_id", F.col("section_no").alias("section"), "note_no", "text"), F.lit(language))
    heads = numbered.select(*SECTION, "kind").distinct().join(words.withColumnRenamed("section", "section_no"), SECTION, "left")
    labelled = materialise(se.label_sections(heads, kinds, language))
    notes = _joined(numbered, SECTION, ["ts_start_ms", "note_no"], F.concat(F.lit("- "), "text"), "notes")
    asked = labelled.select(*SECTION, "title").join(notes, SECTION).withColumn("text", F.concat("title", F.lit("\n"), "notes"))
    written = materialise(co.map_text(asked, open_writer).select(*SECTION, "title", "notes", F.col("answer").alias("body")))      # a model is asked once
    kept = materialise(se.trim_repeated_bullets(written, language))
    bodies = materialise(_joined(kept, SECTION, ["line_no"], F.col("line"), "body"))
    if open_reviewer is None:
        return labelled, written, kept, bodies, None
    reread = bodies.join(written.select(*SECTION, "notes"), SECTION).withColumn("text", F.concat("notes", F.lit("\n\n"), "body"))
    said = materialise(co.map_text(reread, open_reviewer).select(*SECTION, "answer"))
    return labelled, written, kept, bodies, materialise(se.review_findings(said, bodies, F.lit(language)))


def _measured(labelled: DataFrame, written: DataFrame, kept: DataFrame, findings: DataFrame | None) -> DataFrame:
    lines = se.page_lines(written).groupBy("recording_id").agg(F.count("*").alias("_said")).join(
        kept.groupBy("recording_id").agg(F.count("*").alias("_kept")), "recording_id", "left")
    measures = labelled.groupBy("recording_id").agg(F.count("*").alias("sections")).join(lines, "recording_id", "left").withColumn(
        "bullets_repeated", F.coalesce(F.col("_said") - F.coalesce("_kept", F.lit(0)), F.lit(0))).drop("_said", "_kept")
    if findings is None:
        return measures.withColumn("findings", F.lit(0).cast("long"))
    count = findings.groupBy("recording_id").agg(F.count("*").alias("findings"))
    return measures.join(count, "recording_id", "left").fillna(0, ["findings"])


def summarise_headings(answers: DataFrame, open_client: LineSource, language: str = "it", fanin: int = 6, max_depth: int = 3, max_fanin: int = 12) -> DataFrame:
    """One page per recording by folding pass answers level by level: the page's rows by field.

    A fold joins at most ``max_fanin`` answers, so no prompt grows with the recording: a long one has more levels instead.
    """
    part = in_order(answers.select("recording_id", "chunk_idx", "answer"), ["recording_id"], ["chunk_idx"], sums={"idx": F.lit(1)})
    part = materialise(part.select("recording_id", (F.col("idx") - 1).alias("idx"), "answer"))
    tree = materialise(no.fold_tree(part.select("recording_id", "idx"), fanin, max_depth, max_fanin))
    deepest = tree.agg(F.max("level")).first()[0] or 0
    finished = None
    for level in range(1, deepest + 1):
        here = tree.where(F.col("level") == level).withColumnRenamed("member", "idx").join(part, ["recording_id", "idx"])
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "answer"))), lambda x: x["answer"]), "\n\n")
        prompts = here.groupBy("recording_id", F.col("group_no").alias("idx")).agg(text.alias("text"))
        part = materialise(co.map_text(prompts, open_client).select("recording_id", "idx", "answer"))
        more = tree.where(F.col("level") == level + 1).select("recording_id").distinct()
        top = part.join(more, "recording_id", "left_anti")
        finished = top if finished is None else finished.unionByName(top)
    return no.parse_sections(finished.withColumnRenamed("idx", "chunk_idx"), language)
