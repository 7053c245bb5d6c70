"""The library of recordings: finding, counting, sampling and keeping entries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as tx

# --- fixed values: clip lengths offered, half-open but for the last ------------
CLASSES = ("under_30_min", "30_to_60_min", "1_to_2_h", "over_2_h")
MINUTE_MS = 60_000
TIME_RANGE = r"(?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3}\s*-->\s*(?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3}"


def classify_text(texts: DataFrame) -> DataFrame:
    """``subtitles`` where the first 4000 characters hold a pair of cue times, else ``prose``."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, 4000)
    return texts.withColumn("kind", F.when(head.rlike(TIME_RANGE), "subtitles").otherwise("prose"))


def duration_class(entries: DataFrame) -> DataFrame:
    """The length class of each clip; null where the length is unknown."""
    m = F.col("duration_ms") / MINUTE_MS
    kind = (F.when(F.col("duration_ms").isNull(), None).when(m < 30, CLASSES[0]).when(m < 60, CLASSES[1])
            .when(m <= 120, CLASSES[2]).otherwise(CLASSES[3]))
    return entries.withColumn("duration_class", kind)


def has_written_notes(notes: Column) -> Column:
    """Whether a notes file says anything beyond its comments."""
    lines = F.split(F.coalesce(notes, F.lit("")), r"\R")
    return F.exists(lines, lambda s: (F.trim(s) != "") & ~F.startswith(F.trim(s), F.lit("#")))


def search_library(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Entries whose text or notes contain each query, whatever the case.

    ``queries(query)`` is what somebody typed: short strings, held as literals, so that nothing is
    shuffled but the hits. The corpus is read once for each ``QUERY_BLOCK`` of them.
    """
    found = [_search_block(entries, block) for block in _blocks(queries.select(F.trim(F.col("query")).alias("query")).where("query <> ''"))]
    return reduce(DataFrame.unionByName, found or [_search_block(entries, [])])


def _blocks(queries: DataFrame) -> Iterator[list[str]]:
    """Distinct queries, ``QUERY_BLOCK`` at a time."""
    rows = queries.distinct().toLocalIterator()
    while block := [r["query"] for r in islice(rows, QUERY_BLOCK)]:
        yield block


def _search_block(entries: DataFrame, wanted: list[str]) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    notes = F.lower(F.coalesce("notes", F.lit(""))) if "notes" in entries.columns else F.lit("")
    hits = F.filter(F.array(*[F.when(F.contains(text, F.lit(q.lower())) | F.contains(notes, F.lit(q.lower())), F.lit(q))
                              for q in wanted]).cast("array<string>"), lambda h: h.isNotNull())
    return entries.withColumn("query", F.explode(hits))


#: Searches answered in one pass over the corpus.
QUERY_BLOCK = 1000


def find_entries(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """What each query names: an exact id, else an id or name it starts, else a title it is in.

    One row per query: ``matches``, ``entry_id`` when there is exactly one, and up to five
    ``candidates`` to show otherwise.
    """
    wanted = queries.select(F.replace(F.trim("query"), F.lit("\\"), F.lit("/")).alias("query")).distinct()
    name, key, title = F.lower("name"), F.lower("entry_id"), F.lower(F.coalesce("title", F.lit("")))

    def tier(q):
        low = F.lit(q.lower())
        return F.when(F.col("entry_id") == q, 1).when(F.startswith(key, low) | F.startswith(name, low), 2).when(F.contains(title, low), 3)

    def named(asked):
        known = F.array(*[F.struct(F.lit(q).alias("query"), tier(q).alias("tier")) for q in asked]).cast("array<struct<query:string,tier:int>>")
        hits = F.filter(known, lambda h: h["tier"].isNotNull())
        return entries.select("entry_id", "name", F.explode(hits).alias("h")).select("entry_id", "name", "h.query", "h.tier")

    e = reduce(DataFrame.unionByName, [named(block) for block in _blocks(wanted.where("query <> ''"))] or [named([])])
    best = e.groupBy("query", "tier").agg(F.count("*").alias("matches"), F.min("entry_id").alias("_one"))
    nearest = best.groupBy("query").agg(F.min_by(F.struct("tier", "matches", "_one"), "tier").alias("b"))
    nth = F.row_number().over(Window.partitionBy("query", "tier").orderBy(F.desc("name"), "entry_id"))
    shown = e.withColumn("_r", nth).where(F.col("_r") <= 5).groupBy("query", "tier").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "entry_id"))), lambda x: x["entry_id"]).alias("candidates"))
    out = (nearest.select("query", F.col("b.tier").alias("tier"), "b.matches", F.col("b._one").alias("_one"))
           .join(shown, ["query", "tier"]))
    return wanted.where("query <> ''").join(out, "query", "left").select(
        "query", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("_one")).alias("entry_id"), "candidates")


def list_folder(entries: DataFrame, folder: str | None = None) -> DataFrame:
    """Entries newest first by name: everywhere, or directly in one folder."""
    if folder is not None:
        entries = entries.where(F.col("folder") == folder)
    return entries.orderBy(F.desc("name"), "entry_id")


def folder_rollup(entries: DataFrame) -> DataFrame:
    """Every folder with the entries directly in it and anywhere below: ``folder, depth, here, below``."""
    direct = entries.groupBy("folder").agg(F.count("*").alias("n"))     # folders, not entries, are exploded
    parts = F.split("folder", "/")
    up = direct.where("folder <> ''").select("folder", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_f"))
    return up.groupBy(F.col("_f").alias("folder")).agg(
        F.max(F.size(F.split("_f", "/"))).alias("depth"), F.sum(F.when(F.col("folder") == F.col("_f"), F.col("n")).otherwise(0)).alias("here"),
        F.sum("n").alias("below"))


def find_copies(entries: DataFrame) -> DataFrame:
    """Recordings filed more than once: each entry with its group's size and newest member.

    A group is never gathered into one row, so a recording copied without end costs no
    more than its rows.
    """
    known = entries.where("coalesce(sha256, '') <> ''").select("entry_id", "name", "sha256")
    groups = known.groupBy("sha256").agg(F.count("*").alias("copies"), F.max_by("entry_id", F.struct("name", "entry_id")).alias("newest")).where("copies > 1")
    return known.join(groups, "sha256").select("sha256", "entry_id", "copies", "newest")


def select_clips(clips: DataFrame, done: DataFrame, mode: str = "add") -> DataFrame:
    """``add``: clips not summarised yet; ``redo``: only those that were."""
    return clips.join(done.select("entry_id").distinct(), "entry_id", {"add": "left_anti", "redo": "left_semi"}[mode])


def sample_clips(clips: DataFrame, n: int, how: str = "random", seed: int = 0) -> DataFrame:
    """The first ``n`` clips by id, or ``n`` at random that the seed fixes."""
    key = [F.col("entry_id")] if how == "sequential" else [F.xxhash64("entry_id", F.lit(seed)), F.col("entry_id")]
    return clips.orderBy(*key).limit(n)


def retain_history(jobs: DataFrame, keep: int = 50) -> DataFrame:
    """Unfinished jobs, and the newest finished ones up to ``keep`` rows in each history.

    ``jobs(recording_id, job_no, finished)``. Only the newest ``keep`` finished rows of a
    history are ever ranked: the window is cut to them before it is shuffled.
    """
    running = jobs.where("not finished")
    open_ = running.groupBy("recording_id").agg(F.count("*").alias("_open"))
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("job_no")))
    recent = jobs.where("finished").withColumn("_r", nth).where(F.col("_r") <= keep)
    kept = recent.join(open_, "recording_id", "left").where(F.col("_r") <= keep - F.coalesce("_open", F.lit(0)))
    return running.unionByName(kept.drop("_r", "_open"))


def throughput(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Seconds of recording per second of work; live recordings left out."""
    by = by or ["model"]
    return entries.where("not live").groupBy(*by).agg(
        F.count("*").alias("recordings"), F.sum("duration_ms").alias("audio_ms"), F.sum("elapsed_ms").alias("elapsed_ms")).withColumn(
        "realtime", F.round(F.try_divide("audio_ms", "elapsed_ms"), 6))


def upsert_metadata(entries: DataFrame, patches: DataFrame) -> DataFrame:
    """Entries with a patch merged in: nested records field by field, all else replaced where given.

    Both share a schema keyed by ``entry_id``; an entry only the patch has is added. Where a patch names fields in
    ``given array<string>`` (nested ones as ``record.field``), what it says of them replaces the entry's, a null too.
    """
    e, p = entries.alias("e"), patches.alias("p")
    j = e.join(p, F.col("e.entry_id") == F.col("p.entry_id"), "full")
    cols = [F.coalesce(F.col("p.entry_id"), F.col("e.entry_id")).alias("entry_id")]

    def newer(name):
        either = F.coalesce(F.col(f"p.{name}"), F.col(f"e.{name}"))
        if "given" not in patches.columns:
            return either
        return F.when(F.coalesce(F.array_contains("p.given", name), F.lit(False)), F.col(f"p.{name}")).otherwise(either)

    for f in entries.schema:
        if f.name == "entry_id":
            continue
        if f.name not in patches.columns:
            cols.append(F.col(f"e.{f.name}"))
        elif f.dataType.typeName() == "struct":
            both = F.struct(*[newer(f"{f.name}.{x}").alias(x) for x in f.dataType.names])
            cols.append(F.when(F.col(f"p.{f.name}").isNull() & F.col(f"e.{f.name}").isNull(), None).otherwise(both).alias(f.name))
        else:
            cols.append(newer(f.name).alias(f.name))
    return j.select(*cols)


#: What a new transcription of a recording takes away: it speaks of a run that is no longer there.
RUN_FIELDS = ("reference", "subtitles", "speaker_names")


def refile(entries: DataFrame, runs: DataFrame, run_fields: tuple[str, ...] = RUN_FIELDS) -> DataFrame:
    """Entries whose recording was transcribed again: what the run says is taken from ``runs``, its stale fields go, the rest stays.

    ``runs`` share columns of ``entries`` by ``entry_id``; of the fields of a run those that ``runs`` does not give are null afterwards, and
    what a person added (title, notes, where it is filed) is kept. A run of an entry that is not there changes nothing.
    """
    again = runs.select("entry_id").distinct().withColumn("_again", F.lit(True))
    kept = entries.join(again, "entry_id", "left")
    stale = {c: F.when(F.col("_again"), F.lit(None)).otherwise(F.col(c)) for c in run_fields if c in entries.columns}
    cleared = kept.withColumns(stale).drop("_again") if stale else kept.drop("_again")
    return upsert_metadata(cleared, runs.join(entries.select("entry_id"), "entry_id", "left_semi")).select(*entries.columns)


def stale_subtitles(stored: DataFrame, written: DataFrame) -> DataFrame:
    """``entry_id, preset`` of subtitle files that a new run did not write and that have to go. Entries without a new run keep theirs."""
    again = written.select("entry_id").distinct()
    return stored.join(again, "entry_id", "left_semi").join(written, ["entry_id", "preset"], "left_anti").select("entry_id", "preset").distinct()


def current_summaries(versions: DataFrame) -> DataFrame:
    """Every summary ever written, the newest of each recording first: ``version`` 0 is current."""
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("written_at"), F.desc("summary")))
    return versions.withColumn("version", (nth - 1).cast("long")).withColumn("current", F.col("version") == 0)


# --- the cache of model answers ----------------------------------------------

PASS_KEY = ["prompt_version", "model", "precision", "stage", "budget", "language", "settings", "text"]


def pass_key(*columns: Column) -> Column:
    """The name an answer is cached under: everything that could change it, hashed."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def reuse_passes(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)``: chunks answered before, with their answer, and those still to ask."""
    keyed = chunks.withColumn("pass_key", pass_key(*[F.col(c) for c in PASS_KEY]))
    known = cache.groupBy("pass_key").agg(F.max_by("answer", "used_at").alias("answer"))
    return keyed.join(known, "pass_key"), keyed.join(known, "pass_key", "left_anti")


def expire_passes(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The cache without answers unused for ``days``."""
    return cache.where(F.col("used_at") >= now - F.make_dt_interval(F.lit(days)))


def catalogue(entries: DataFrame, query: str) -> DataFrame:
    """The search page: matching entries, newest first, with copies counted over the whole library."""
    spark = entries.sparkSession
    hits = search_library(entries, spark.createDataFrame([(query,)], "query string"))
    copies = find_copies(entries).select("entry_id", "copies")
    return (hits.join(copies, "entry_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
            .withColumn("readable", F.col("title").isNotNull()).orderBy(F.desc("name"), "entry_id"))
