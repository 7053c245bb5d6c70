"""The library over the entries fixture."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql
from colloquy.operators import catalogue as ca

E = "entry_id"


@query("classify_text", sql("segments", """,
 t as (select recording_id, seg_no, case when seg_no%5=0 then '00:01:02,300 --> 00:01:04,000'||chr(10)||text else text end as text from segments)
 select recording_id, seg_no, case when regexp_matches(substr(text,1,4000),'(?:\\d{1,3}:)?\\d{1,2}:\\d{2}[.,]\\d{1,3}\\s*-->\\s*(?:\\d{1,3}:)?\\d{1,2}:\\d{2}[.,]\\d{1,3}') then 'subtitles' else 'prose' end as kind from t"""))
def _(spark, sf):
    t = fx.segments(spark, sf).withColumn("text", F.when(
        F.col("seg_no") % 5 == 0, F.concat(F.lit("00:01:02,300 --> 00:01:04,000\n"), "text")).otherwise(F.col("text")))
    return ca.classify_text(t).select("recording_id", "seg_no", "kind")


@query("duration_class", sql("entries", """select case when duration_ms/60000.0<30 then 'under_30_min' when duration_ms/60000.0<60 then '30_to_60_min'
 when duration_ms/60000.0<=120 then '1_to_2_h' else 'over_2_h' end as duration_class, count(*) as clips from entries group by 1"""))
def _(spark, sf):
    return ca.duration_class(fx.entries(spark, sf)).groupBy("duration_class").agg(F.count("*").alias("clips"))


_NOTES = "case when doc_id%3=0 then '# to do'||chr(10)||'  ' when doc_id%3=1 then '# head'||chr(10)||'call '||source else '' end"


def with_notes(spark, sf):
    d = F.col("doc_id")
    return fx.entries(spark, sf).withColumn("notes", F.when(d % 3 == 0, "# to do\n  ").when(
        d % 3 == 1, F.concat(F.lit("# head\ncall "), F.split_part("folder", F.lit("/"), F.lit(2)))).otherwise(""))


@query("has_written_notes", sql("entries", "select entry_id, doc_id%3=1 as written from entries"))
def _(spark, sf):
    return with_notes(spark, sf).select(E, ca.has_written_notes(F.col("notes")).alias("written"))


QUERIES = ["The", "aux le", "call src1", "zzzz"]


@query("search_library", sql("entries", f""", n as (select e.*, {_NOTES.replace('source', "split_part(folder,'/',2)")} as notes from entries e)
 select q as query, entry_id from n, (values {','.join(f"('{q}')" for q in QUERIES)}) v(q) where contains(lower(text), lower(q)) or contains(lower(notes), lower(q))"""))
def _(spark, sf):
    q = spark.createDataFrame([(x,) for x in QUERIES], "query string")
    return ca.search_library(with_notes(spark, sf), q).select("query", E)


NAMES = ["2026-01-01", "en/src1/2026-01-05", "2026-01-02_0130_rec-1", "ouèl", "nothing like it"]


@query("find_entries", sql("entries", f""", q(query) as (values {','.join(f"('{q}')" for q in NAMES)}),
 h as (select query, entry_id, name, case when entry_id=query then 1 when starts_with(lower(entry_id),lower(query)) or starts_with(lower(name),lower(query)) then 2
   when contains(lower(title),lower(query)) then 3 end as tier from entries, q),
 b as (select query, min(tier) as tier from h where tier is not null group by query),
 m as (select h.query, count(*) as matches, min(entry_id) as one, (list(entry_id order by name desc, entry_id))[1:5] as candidates from h join b on h.query=b.query and h.tier=b.tier group by h.query)
 select q.query, coalesce(matches,0) as matches, case when matches=1 then one end as entry_id, candidates from q left join m on q.query=m.query"""))
def _(spark, sf):
    return ca.find_entries(fx.entries(spark, sf), spark.createDataFrame([(x,) for x in NAMES], "query string"))


@query("list_entries", sql("entries", "select entry_id, name from entries where folder='en/src1'"))
def _(spark, sf):
    return ca.list_folder(fx.entries(spark, sf), "en/src1").select(E, "name")


@query("folder_rollup", sql("entries", """, f as (select split_part(folder,'/',1) as folder, 1 as depth, 0::BIGINT as here from entries union all select folder, 2, 1 from entries)
 select folder, depth, sum(here)::BIGINT as here, count(*) as below from f group by folder, depth"""))
def _(spark, sf):
    return ca.folder_rollup(fx.entries(spark, sf))


@query("find_copies", sql("entries", """, g as (select sha256, count(*) as copies, arg_max(entry_id, (name, entry_id)) as newest from entries group by sha256 having count(*)>1)
 select e.sha256, e.entry_id, copies, newest from entries e join g using (sha256)"""))
def _(spark, sf):
    return ca.find_copies(fx.entries(spark, sf))


@query("select_clips_add", sql("entries", "select entry_id from entries where doc_id not in (select doc_id from labels)"))
def _(spark, sf):
    e = fx.entries(spark, sf)
    done = e.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id").select(E)
    return ca.select_clips(e, done).select(E)


@query("select_clips_redo", sql("entries", "select entry_id from entries where doc_id in (select doc_id from labels)"))
def _(spark, sf):
    e = fx.entries(spark, sf)
    done = e.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id").select(E)
    return ca.select_clips(e, done, "redo").select(E)


@query("sample_clips_sequential", sql("entries", "select entry_id from entries order by entry_id limit 25"))
def _(spark, sf):
    return ca.sample_clips(fx.entries(spark, sf), 25, "sequential").select(E)


@query("sample_clips_random")
def _(spark, sf):
    return ca.sample_clips(fx.entries(spark, sf), 25, seed=7).select(E)


@query("retain_history", """with j as (select user_id as recording_id, event_id as job_no, event_type not in ('click','view') as finished from events),
 o as (select recording_id, count(*) as n from j where not finished group by 1),
 r as (select *, row_number() over (partition by recording_id order by job_no desc) as rn from j where finished)
 select recording_id, job_no, finished from j where not finished
 union all select r.recording_id, job_no, finished from r left join o using (recording_id) where rn<=50-coalesce(n,0)""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    return ca.retain_history(e.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("job_no"),
                                      (~F.col("event_type").isin("click", "view")).alias("finished")))


@query("throughput", sql("entries", """select model, count(*) as recordings, sum(duration_ms)::BIGINT as audio_ms, sum(elapsed_ms)::BIGINT as elapsed_ms,
 round(sum(duration_ms)/sum(elapsed_ms),6) as realtime from entries where not live group by model"""))
def _(spark, sf):
    return ca.throughput(fx.entries(spark, sf))


def _meta(e):
    return e.select(E, "title", F.struct(F.col("name").alias("filename"), "sha256").alias("source"),
                    F.struct("language", "model").alias("transcription"))


@query("upsert_metadata", sql("entries", """select entry_id, case when doc_id%4=0 then 'New '||doc_id else title end as title, name as filename,
 sha256, case when doc_id%4=0 then 'it' else language end as language, model from entries
 union all select 'added/'||doc_id, 'New '||doc_id, null, null, 'it', null from entries where doc_id%50=0"""))
def _(spark, sf):
    e = fx.entries(spark, sf)
    d = F.col("doc_id")
    patch = e.where("doc_id % 4 = 0").withColumns({"title": F.concat(F.lit("New "), d), "language": F.lit("it"), "model": F.lit(None).cast("string"),
                                                   "sha256": F.lit(None).cast("string"), "name": F.lit(None).cast("string")})
    new = patch.where("doc_id % 50 = 0").withColumn(E, F.concat(F.lit("added/"), d))
    more = e.where("doc_id % 50 = 0 and doc_id % 4 <> 0").withColumns({
        "title": F.concat(F.lit("New "), d), "language": F.lit("it"), "model": F.lit(None).cast("string"), "sha256": F.lit(None).cast("string"),
        "name": F.lit(None).cast("string"), E: F.concat(F.lit("added/"), d)})
    out = ca.upsert_metadata(_meta(e), _meta(patch.unionByName(new).unionByName(more)))
    return out.select(E, "title", "source.filename", "source.sha256", "transcription.language", "transcription.model")


@query("refile", sql("entries", """ select entry_id, title, language, case when doc_id%3=0 then 'second run' else model end as model,
 case when doc_id%3=0 then null else name end as reference, case when doc_id%3=0 and doc_id%2=1 then null when doc_id%3=0 then 'kept by the run' else sha256 end as speaker_names from entries"""))
def _(spark, sf):
    e = fx.entries(spark, sf)
    filed = e.select(E, "title", "language", "model", F.col("name").alias("reference"), F.col("sha256").alias("speaker_names"))
    d = F.col("doc_id")
    runs = e.where("doc_id % 3 = 0").select(E, F.lit("second run").alias("model"), F.when(d % 2 == 0, "kept by the run").alias("speaker_names"))
    return ca.refile(filed, runs.unionByName(runs.limit(1).withColumn(E, F.lit("of no entry"))))


@query("version_summaries", """with v as (select user_id as recording_id, ts::TIMESTAMP as written_at, event_type as summary from events)
 select recording_id, summary, row_number() over (partition by recording_id order by written_at desc, summary desc)-1 as version,
 row_number() over (partition by recording_id order by written_at desc, summary desc)=1 as current from v""")
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    return ca.current_summaries(e.select(F.col("user_id").alias("recording_id"), F.col("ts").alias("written_at"),
                                         F.col("event_type").alias("summary"))).drop("written_at")


def _chunks(spark, sf):
    a = fx.answers(spark, sf)
    return a.select("recording_id", "chunk_idx", F.lit("3").alias("prompt_version"), F.lit("base").alias("model"), F.lit("int8").alias("precision"),
                    F.lit("read").alias("stage"), F.lit(1200).alias("budget"), F.lit("en").alias("language"), F.lit("{}").alias("settings"),
                    F.col("answer").alias("text"))


_KEY = "sha256(concat_ws(chr(0),'3','base','int8','read','1200','en','{}',answer))"


@query("reuse_passes", sql("answers", f"""select recording_id, chunk_idx, {_KEY} as pass_key, recording_id%3=0 as hit from answers"""))
def _(spark, sf):
    c = _chunks(spark, sf)
    cache = c.where("recording_id % 3 = 0").select(ca.pass_key(*[F.col(x) for x in ca.PASS_KEY]).alias("pass_key"),
                                                   F.lit("kept").alias("answer"), F.lit(1).alias("used_at"))
    hits, misses = ca.reuse_passes(c, cache)
    return (hits.select("recording_id", "chunk_idx", "pass_key", F.lit(True).alias("hit"))
            .unionByName(misses.select("recording_id", "chunk_idx", "pass_key", F.lit(False).alias("hit"))))


@query("expire_passes", "select event_id from events where ts >= timestamp '2024-01-31 00:00:00' - interval 10 day")
def _(spark, sf):
    c = fx.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("used_at"))
    return ca.expire_passes(c, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 10).select("event_id")


@query("job_catalogue", sql("entries", """, c as (select sha256, count(*) as copies from entries group by 1)
 select entry_id, copies from entries join c using (sha256) where contains(lower(text),'the')"""))
def _(spark, sf):
    return ca.catalogue(fx.entries(spark, sf), "the ").select(E, "copies")
