"""Recordings derived from the driver tables, as Spark views and as the same SQL.

The driver tables hold no speech; these views give their rows the shape of segments,
words, turns, notes and library entries. Operators never see them: they are inputs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.lexicons import ACCENTED, PLAIN
from colloquy.plans.ordered import in_order
from colloquy.plans.store import materialise


_WRITTEN: dict[tuple, DataFrame] = {}


def written(view):
    """Derive a view once per session and folder, as the table a user would already have."""
    def read(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, view.__name__, sf)
        if key not in _WRITTEN:
            _WRITTEN[key] = materialise(view(spark, sf))
        return _WRITTEN[key]
    return functools.wraps(view)(read)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Bytes of a table's files that one task works on.
TASK_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """The driver's tables are few files of large row groups, which few tasks would read alone; a task's share does not grow with the table."""
    tasks, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    size = df.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
    tasks = max(tasks, -(-size // TASK_BYTES))
    return df.repartition(tasks) if len(files) < tasks else df


def _pieces(text):
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.split(F.regexp_replace(flat, "([.!?…]) ", "$1\x1f"), "\x1f")


@written
def segments(spark: SparkSession, sf: str) -> DataFrame:
    """V1: one segment per sentence of each conversation turn."""
    pieces = (spread(table(spark, sf, "conversations"))
              .select("conv_id", "turn", F.col("role").alias("speaker"),
                      F.posexplode(_pieces(F.col("text"))).alias("pos", "text"))
              .where("text <> ''"))
    dur = F.greatest(F.lit(200), 60 * F.length("text")).cast("long")
    gap = F.when(F.col("pos") == 0, F.when(F.col("turn") == 0, 0).otherwise(1500)).otherwise(200)
    timed = in_order(pieces.withColumn("dur", dur), ["conv_id"], ["turn", "pos"],
                     block=F.floor(F.col("turn") / 64),
                     sums={"end_ms": F.col("dur") + gap, "n": F.lit(1)})
    return timed.select(F.col("conv_id").alias("recording_id"), (F.col("n") - 1).alias("seg_no"),
                        "turn", "speaker", "text", (F.col("end_ms") - F.col("dur")).alias("start_ms"),
                        "end_ms")


@written
def invented(spark: SparkSession, sf: str) -> DataFrame:
    """V1a: segments with invented phrases in front, behind, inside and alone."""
    s = in_order(segments(spark, sf), ["recording_id"], ["seg_no"],
                 lead={"after": F.col("seg_no")})
    kind, at = F.col("recording_id") % 5, F.col("seg_no")
    text = (F.when((kind == 1) & (at == 0), F.concat(F.lit("Thank you. Thank you for watching. "), "text"))
            .when((kind == 2) & (at == 2), F.concat("text", F.lit(" Grazie a tutti")))
            .when((kind == 3) & (at == 1),
                  F.concat("text", F.lit(" Sottotitoli e revisione a cura di QTSS "), "text"))
            .otherwise(F.col("text")))
    final = (F.array(F.struct(F.lit(0).alias("i"), text.alias("t")),
                     F.struct(F.lit(1).alias("i"), F.lit("Thanks for watching!").alias("t"))))
    both = F.when((kind == 0) & F.col("after").isNull(), final).otherwise(F.slice(final, 1, 1))
    extra = F.col("e.i") == 1
    return s.withColumn("e", F.explode(both)).select(
        "recording_id", (at + F.col("e.i")).alias("seg_no"), "turn",
        F.when(extra, F.lit("user")).otherwise(F.col("speaker")).alias("speaker"),
        F.col("e.t").alias("text"),
        F.when(extra, F.col("end_ms") + 500).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(extra, F.col("end_ms") + 1500).otherwise(F.col("end_ms")).alias("end_ms"))


@written
def doubled(spark: SparkSession, sf: str) -> DataFrame:
    """V1b: segments whose head repeats the one before, and segments heard twice."""
    s = in_order(segments(spark, sf), ["recording_id"], ["seg_no"], lag={"prev": F.col("text")})
    ten = F.regexp_extract(F.col("prev"), r"((?:\S+ ){9}\S+)$", 1)
    at = F.col("seg_no")
    text = F.when((at % 9 == 4) & (F.coalesce(ten, F.lit("")) != ""),
                  F.concat(ten, F.lit(" "), "text")).otherwise(F.col("text"))
    copies = F.when(at % 11 == 6, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = s.withColumn("text", text).withColumn("dup", F.explode(copies))
    n = in_order(twice, ["recording_id"], ["seg_no", "dup"], sums={"n": F.lit(1)})
    return n.select("recording_id", (F.col("n") - 1).alias("seg_no"), "turn", "speaker", "text",
                    "start_ms", "end_ms")


@written
def words(spark: SparkSession, sf: str) -> DataFrame:
    """V2: the words of V1, each with its share of the segment's time."""
    s = segments(spark, sf).withColumn("w", F.split("text", " "))
    lens = F.transform("w", lambda x: F.length(x))
    s = s.withColumn("total", F.aggregate(lens, F.lit(0), lambda a, x: a + x))
    e = s.select("*", F.posexplode("w").alias("word_no", "word"))
    upto = F.aggregate(F.slice("w", F.lit(1), F.col("word_no") + 1), F.lit(0), lambda a, x: a + F.length(x))
    dur = F.col("end_ms") - F.col("start_ms")
    e = e.withColumn("upto", upto)
    return e.select(
        "recording_id", "seg_no", F.col("word_no").cast("long").alias("word_no"), "word", "speaker",
        (F.col("start_ms") + F.floor(dur * (F.col("upto") - F.length("word")) / F.col("total"))).cast("long").alias("start_ms"),
        (F.col("start_ms") + F.floor(dur * F.col("upto") / F.col("total"))).cast("long").alias("end_ms"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """V3: speaker turns that overlap one another and leave stretches uncovered."""
    r = F.col("recording_id")
    return (segments(spark, sf).where("turn % 6 <> 5").groupBy("recording_id", "turn")
            .agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min("speaker").alias("speaker"))
            .select("recording_id", "turn",
                    F.greatest(F.lit(0), F.col("s") - 1500 * (r % 3)).cast("long").alias("turn_start_ms"),
                    (F.col("e") + 900 * (r % 4)).cast("long").alias("turn_end_ms"), "speaker"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """V5: a library with one entry per document."""
    d = F.col("doc_id")
    day = F.lpad((d % 28 + 1).cast("string"), 2, "0")
    hour = F.lpad((d % 24).cast("string"), 2, "0")
    return spread(table(spark, sf, "documents")).select(
        F.concat_ws("/", "lang", "source", F.concat(F.lit("2026-01-"), day, F.lit("_"), hour, F.lit("30_rec-"), d.cast("string"))).alias("entry_id"),
        F.concat_ws("/", "lang", "source").alias("folder"),
        F.concat(F.lit("2026-01-"), day, F.lit("_"), hour, F.lit("30_rec-"), d.cast("string")).alias("name"),
        F.substring("text", 1, 40).alias("title"), F.sha2("text", 256).alias("sha256"),
        (F.col("n_chars") * 60).alias("duration_ms"),
        (F.col("n_chars") * (40 + d % 5 * 20)).alias("elapsed_ms"),
        F.element_at(F.array(F.lit("tiny"), F.lit("base"), F.lit("small")), (d % 3 + 1).cast("int")).alias("model"),
        (d % 7 == 0).alias("live"), F.col("lang").alias("language"), F.col("n_chars"), "text", "doc_id")


def prose(spark: SparkSession, sf: str) -> DataFrame:
    """V6: recordings that are plain text."""
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("recording_id"), "text",
                                                F.col("lang").alias("language"))


def heard(spark: SparkSession, sf: str) -> DataFrame:
    """V7: V2 with the third letter of some long words missed; ``given`` is the text's word."""
    miss = (F.col("word_no") % 13 == 5) & (F.length("word") >= 8)
    short = F.concat(F.substring("word", 1, 2), F.expr("substring(word, 4)"))
    return words(spark, sf).select("recording_id", "seg_no", "word_no", F.col("word").alias("given"),
                                   F.when(miss, short).otherwise(F.col("word")).alias("heard"))


def voices(spark: SparkSession, sf: str) -> DataFrame:
    """V8: a voice vector per segment."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 100).cast("long").alias("recording_id"),
        (F.col("vec_id") % 100).alias("seg_no"), F.col("embedding").alias("vector"),
        F.concat(F.lit("SPEAKER_"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("speaker"))


@written
def answers(spark: SparkSession, sf: str) -> DataFrame:
    """V9: one written answer per assistant turn: a heading and a bullet per segment."""
    sec = F.floor(F.col("start_ms") / 1000)
    clock = F.concat(F.lit("["), F.floor(sec / 60).cast("string"), F.lit(":"),
                     F.lpad((sec % 60).cast("string"), 2, "0"), F.lit("] "))
    bullet = F.concat(F.lit("- "), F.when(F.col("seg_no") % 3 == 0, F.lit("")).otherwise(clock), "text")
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]),
                           ((F.col("recording_id") + F.col("turn")) % 5 + 1).cast("int"))
    return (segments(spark, sf).where("speaker = 'assistant'").withColumn("b", bullet)
            .groupBy("recording_id", "turn")
            .agg(F.sort_array(F.collect_list(F.struct("seg_no", "b"))).alias("l"),
                 F.min("start_ms").alias("span_start_ms"), F.max("end_ms").alias("span_end_ms"))
            .select("recording_id", F.col("turn").alias("chunk_idx"),
                    F.concat(F.lit("## "), heading, F.lit("\n"), F.array_join("l.b", "\n")).alias("answer"),
                    "span_start_ms", "span_end_ms"))


HEADINGS = ["Decisions", "Azioni", "Open questions", "Problem", "Weather"]


@written
def frames(spark: SparkSession, sf: str) -> DataFrame:
    """V10: one sample per event, numbered in time order within its user."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("sample"))
    n = in_order(e, ["recording_id"], ["ts", "event_id"], sums={"n": F.lit(1)},
                 block=F.floor(F.unix_seconds(F.col("ts")) / 86400))
    return n.select("recording_id", (F.col("n") - 1).alias("frame_no"), "ts", "sample")


# --- the same views in SQL ---------------------------------------------------

SQL = {
    "segments": """
 s0 as (select conv_id, turn, role, string_split(regexp_replace(trim(regexp_replace(text,'\\s+',' ','g')),
          '([.!?…]) ','\\1'||chr(31),'g'), chr(31)) a from conversations),
 s1 as (select conv_id, turn, role, unnest(a) as text, generate_subscripts(a,1)-1 as pos from s0),
 s2 as (select *, greatest(200, 60*length(text)) as dur,
          case when pos=0 then (case when turn=0 then 0 else 1500 end) else 200 end as gap from s1 where text<>''),
 s3 as (select *, sum(dur+gap) over (partition by conv_id order by turn,pos)::BIGINT as end_ms from s2),
 segments as (select conv_id as recording_id,
          (row_number() over (partition by conv_id order by turn,pos)-1)::BIGINT as seg_no,
          turn, role as speaker, text, (end_ms-dur)::BIGINT as start_ms, end_ms from s3)""",
    "invented": """
 i0 as (select *, max(seg_no) over (partition by recording_id) as last_no from segments),
 invented as (select recording_id, seg_no, turn, speaker,
          case when recording_id%5=1 and seg_no=0 then 'Thank you. Thank you for watching. '||text
               when recording_id%5=2 and seg_no=2 then text||' Grazie a tutti'
               when recording_id%5=3 and seg_no=1 then text||' Sottotitoli e revisione a cura di QTSS '||text
               else text end as text, start_ms, end_ms from i0
          union all select recording_id, seg_no+1, turn, 'user', 'Thanks for watching!', end_ms+500, end_ms+1500
          from i0 where recording_id%5=0 and seg_no=last_no)""",
    "doubled": """
 d0 as (select *, lag(text) over (partition by recording_id order by seg_no) as prev from segments),
 d1 as (select *, coalesce(regexp_extract(prev,'((?:\\S+ ){9}\\S+)$',1),'') as ten from d0),
 d2 as (select recording_id, seg_no, turn, speaker, start_ms, end_ms, d.dup,
          case when seg_no%9=4 and ten<>'' then ten||' '||text else text end as text
          from d1, (values (0),(1)) d(dup) where d.dup=0 or seg_no%11=6),
 doubled as (select recording_id, (row_number() over (partition by recording_id order by seg_no,dup)-1)::BIGINT as seg_no,
          turn, speaker, text, start_ms, end_ms from d2)""",
    "words": """
 w0 as (select *, string_split(text,' ') as w from segments),
 w1 as (select recording_id, seg_no, speaker, start_ms as s, end_ms as e, unnest(w) as word,
          generate_subscripts(w,1)-1 as word_no from w0),
 w2 as (select *, sum(length(word)) over (partition by recording_id, seg_no order by word_no) as upto,
          sum(length(word)) over (partition by recording_id, seg_no) as total from w1),
 words as (select recording_id, seg_no, word_no::BIGINT as word_no, word, speaker,
          (s + ((e-s)*(upto-length(word)))//total)::BIGINT as start_ms,
          (s + ((e-s)*upto)//total)::BIGINT as end_ms from w2)""",
    "turns": """
 turns as (select recording_id, turn, greatest(0, min(start_ms)-1500*(recording_id%3))::BIGINT as turn_start_ms,
          (max(end_ms)+900*(recording_id%4))::BIGINT as turn_end_ms, min(speaker) as speaker
          from segments where turn%6<>5 group by recording_id, turn)""",
    "entries": """
 e0 as (select *, '2026-01-'||lpad((doc_id%28+1)::VARCHAR,2,'0')||'_'||lpad((doc_id%24)::VARCHAR,2,'0')||'30_rec-'||doc_id as name
          from documents),
 entries as (select lang||'/'||source||'/'||name as entry_id, lang||'/'||source as folder, name,
          substr(text,1,40) as title, sha256(text) as sha256, n_chars*60 as duration_ms,
          n_chars*(40+doc_id%5*20) as elapsed_ms, ['tiny','base','small'][(doc_id%3+1)::INT] as model,
          doc_id%7=0 as live, lang as language, n_chars, text, doc_id from e0)""",
    "prose": """
 prose as (select doc_id as recording_id, text, lang as language from documents)""",
    "heard": """
 heard as (select recording_id, seg_no, word_no, word as given,
          case when word_no%13=5 and length(word)>=8 then substr(word,1,2)||substr(word,4) else word end as heard
          from words)""",
    "voices": """
 voices as (select vec_id//100 as recording_id, vec_id%100 as seg_no, embedding as vector,
          'SPEAKER_'||lpad(label::VARCHAR,2,'0') as speaker from embeddings)""",
    "answers": """
 a0 as (select *, start_ms//1000 as sec from segments where speaker='assistant'),
 a1 as (select *, '- '||case when seg_no%3=0 then '' else '['||(sec//60)||':'||lpad((sec%60)::VARCHAR,2,'0')||'] ' end||text as b from a0),
 answers as (select recording_id, turn as chunk_idx, '## '||
          ['Decisions','Azioni','Open questions','Problem','Weather'][((recording_id+turn)%5+1)::INT]||chr(10)||
          string_agg(b, chr(10) order by seg_no) as answer, min(start_ms) as span_start_ms, max(end_ms) as span_end_ms
          from a1 group by recording_id, turn)""",
    "frames": """
 frames as (select user_id as recording_id,
          (row_number() over (partition by user_id order by ts, event_id)-1)::BIGINT as frame_no,
          ts, least(value/500, 1.0) as sample from events)""",
}
NEEDS = {"invented": ["segments"], "doubled": ["segments"], "words": ["segments"], "turns": ["segments"],
         "heard": ["segments", "words"], "answers": ["segments"]}

#: The fold of the text functions, spelled for SQL.
SQL_FOLD = f"translate(lower({{}}),'{ACCENTED}','{PLAIN}')"


def sql(views: str, body: str) -> str:
    """``body`` (further CTEs and a final select) over the named views."""
    wanted: list[str] = []
    for v in views.split():
        for n in [*NEEDS.get(v, []), v]:
            if n not in wanted:
                wanted.append(n)
    return "with " + ",".join(SQL[n] for n in wanted) + "\n" + body


def sql_fold(expr: str) -> str:
    return SQL_FOLD.format(expr)
