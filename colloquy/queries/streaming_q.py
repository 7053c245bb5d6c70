"""Streams over the events fixture, drained and read back as tables."""

import uuid

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.functions import text as tx
from colloquy.queries import layout_q  # noqa: F401 - its SQL is used here
from colloquy.registry import ORACLES, query
from colloquy.fixtures import sql
from colloquy.plans.store import materialise, shared_dir
from colloquy.streaming import live

#: Far past every event: it carries the watermark over the last open windows.
LATER = "2100-01-01 00:00:00"


def drained(stream, mode="append"):
    """Run a stream over what its source holds and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with live.state_store(spark):
        running = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
                   .trigger(availableNow=True).start())
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def streamed(df, order=None):
    """A table as the files of a stream: its rows by day, then the sentinel."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    df.write.parquet(path)
    last = df.limit(1)
    for c in df.columns:
        kind = df.schema[c].dataType.typeName()
        if kind == "timestamp":
            last = last.withColumn(c, F.to_timestamp(F.lit(LATER)))
        elif c in ("recording_id", "seg_no", "turn"):
            last = last.withColumn(c, F.lit(-1).cast(df.schema[c].dataType))
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1000).parquet(path)


def live_rows(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("recording_id"), F.col("event_id").alias("seg_no"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("text"), "value")


@query("live_segments", sql("segments", """
 select recording_id, turn as piece_no, text, case when seg_no%9=3 then null else start_ms end as start_ms, end_ms from segments"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    at = F.min("start_ms").alias("piece_start_ms")
    p = s.groupBy("recording_id", F.col("turn").alias("piece_no")).agg(at, F.sort_array(F.collect_list(F.struct("seg_no", "text", "start_ms", "end_ms"))).alias("_s"))
    none = F.array().cast("array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    p = p.select("recording_id", "piece_no", "piece_start_ms", F.to_timestamp(F.lit("2026-01-01 09:00:00")).alias("started_at"), F.transform("_s", lambda x: F.struct(
        x["text"].alias("text"), F.when(x["seg_no"] % 9 != 3, x["start_ms"] - F.col("piece_start_ms")).alias("start_ms"),
        (x["end_ms"] - F.col("piece_start_ms")).alias("end_ms"), none.alias("words"))).alias("segments"))
    out = drained(live.live_segments(streamed(materialise(p))))
    return out.where("recording_id >= 0").select("recording_id", "piece_no", "text", "start_ms", "end_ms")


@query("live_paragraphs", """with l as (select user_id as recording_id, ts, event_id, event_type, lag(ts) over (partition by user_id order by ts, event_id) as pv from events),
 i as (select *, sum(case when pv is null or ts-pv>interval 6 hour then 1 else 0 end) over (partition by recording_id order by ts, event_id) as g from l)
 select recording_id, count(*) as segments, length(string_agg(event_type,' '))::INT as chars from i group by recording_id, g""")
def _(spark, sf):
    out = drained(live.live_paragraphs(streamed(live_rows(spark, sf)), 6 * 3_600_000, None))
    return out.where("recording_id >= 0").select("recording_id", "segments", F.length("text").alias("chars"))


@query("live_paragraphs_of_segments", f"select recording_id, start_ms, end_ms, text from ({ORACLES['paragraphs']}) p")
def _(spark, sf):
    """Segments with lengths, against the SQL of the stored paragraphs."""
    def at(c):
        return F.timestamp_millis(F.lit(1_767_225_600_000) + F.col(c))
    s = fx.segments(spark, sf).select("recording_id", "seg_no", at("start_ms").alias("ts"), at("end_ms").alias("ts_end"), "text")
    out = drained(live.live_paragraphs(streamed(s))).where("recording_id >= 0")
    def ms(c):
        return F.unix_millis(c) - 1_767_225_600_000
    return out.select("recording_id", ms("started").alias("start_ms"), ms("ended").alias("end_ms"), tx.clean_text(F.col("text")).alias("text"))


@query("live_coverage", """select user_id as recording_id, strftime(date_trunc('minute', ts),'%Y-%m-%d %H:%M') as minute, count(*) as segments, count(*) as words from events group by all""")
def _(spark, sf):
    out = drained(live.live_coverage(streamed(live_rows(spark, sf))))
    return out.where("recording_id >= 0").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


def _blocks(spark, sf):
    return live_rows(spark, sf).select("recording_id", "ts", (F.least(F.col("value") / 500, F.lit(1.0)) ** 2).alias("mean_square"),
                                       ((F.col("seg_no") % 10) / 10).alias("band_ratio"))


@query("signal_activity", """with e as (select user_id as recording_id, ts::TIMESTAMP as ts, power(least(value/500,1.0),2) as ms, (event_id%10)/10.0::DOUBLE as band from events),
 d as (select *, case when ms>0 then 10*log10(ms) else -120 end as db from e),
 w as (select recording_id, db, band, unnest([time_bucket(interval 6 hour, ts)+interval 6 hour, time_bucket(interval 6 hour, ts)+interval 12 hour]) as at_ts from d),
 q as (select *, count(*) over p as n, quantile_cont(db, 0.9) over p as level, quantile_cont(db, 0.2) over p as floor_ from w window p as (partition by recording_id, at_ts)),
 g as (select recording_id, at_ts, any_value(n) as n, any_value(level) as level, any_value(floor_) as floor_, count(*) filter (where db>floor_+6) as loud,
   coalesce(avg(band) filter (where db>floor_+6), avg(band)) as band from q group by all)
 select recording_id, strftime(at_ts,'%Y-%m-%d %H:%M') as at, n::INT as blocks, case when n<4 then null when level < -50 then 'silence'
  when level-floor_>=6 and loud/n between 0.05 and 0.95 and round(band,9)>=0.5 then 'speech' else 'sound' end as verdict from g""")
def _(spark, sf):
    out = drained(live.signal_activity(streamed(_blocks(spark, sf)), min_blocks=4, window="12 hours", slide="6 hours"))
    return out.where("recording_id >= 0").select("recording_id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "blocks", "verdict")


@query("live_trail", """with e as (select user_id as recording_id, ts, power(least(value/500,1.0),2) as ms from events),
 w as (select recording_id, ms, unnest([time_bucket(interval 1 hour, ts)+interval 1 hour, time_bucket(interval 1 hour, ts)+interval 2 hour]) as at_ts from e)
 select recording_id, strftime(at_ts,'%Y-%m-%d %H:%M') as at, round(sqrt(avg(ms)),6) as rms, count(*) as blocks from w group by all""")
def _(spark, sf):
    out = drained(live.live_trail(streamed(_blocks(spark, sf)), window="2 hours", slide="1 hour"))
    return out.where("recording_id >= 0").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm"))


@query("live_dedup", "select user_id as recording_id, event_id as seg_no, event_type as text from events")
def _(spark, sf):
    rows = live_rows(spark, sf)
    twice = rows.unionByName(rows.where("seg_no % 3 = 0"))
    return drained(live.live_dedup(streamed(twice))).where("recording_id >= 0").select("recording_id", "seg_no", "text")


@query("live_assign_speakers", sql("segments turns", """,
 o as (select s.recording_id, s.seg_no, t.speaker, row_number() over (partition by s.recording_id, s.seg_no
        order by least(s.end_ms,t.turn_end_ms)-greatest(s.start_ms,t.turn_start_ms) desc, t.turn) as rn
   from segments s join turns t on s.recording_id=t.recording_id and s.start_ms<t.turn_end_ms and s.end_ms>t.turn_start_ms)
 select s.recording_id, s.seg_no, o.speaker from segments s left join o on o.recording_id=s.recording_id and o.seg_no=s.seg_no and rn=1"""))
def _(spark, sf):
    def at(c):
        return F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.col(c) * 1000)
    s = fx.segments(spark, sf).select("recording_id", "seg_no", at("start_ms").alias("ts"), at("end_ms").alias("ts_end"))
    t = fx.turns(spark, sf).select("recording_id", "turn", at("turn_start_ms").alias("turn_ts"), at("turn_end_ms").alias("turn_ts_end"), "speaker")
    return drained(live.live_assign_speakers(streamed(s), streamed(t))).where("recording_id >= 0")


def _clock(c):
    return F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.col(c) * 1000)


def _turn_rows(spark, sf):
    return fx.turns(spark, sf).select("recording_id", "turn", _clock("turn_start_ms").alias("turn_ts"), _clock("turn_end_ms").alias("turn_ts_end"), "speaker")


@query("live_speakers", ORACLES["assign_speakers"])
def _(spark, sf):
    """Against the SQL of the stored segments."""
    s = fx.segments(spark, sf).select("recording_id", "seg_no", _clock("start_ms").alias("ts"), _clock("end_ms").alias("ts_end"))
    return drained(live.live_speakers(streamed(s), streamed(_turn_rows(spark, sf)))).where("recording_id >= 0")


@query("job_live", f"""select p.recording_id, p.start_ms, p.end_ms, s.speaker, p.text from ({ORACLES['paragraphs']}) p
 join (select a.recording_id, x.start_ms, a.speaker from ({ORACLES['assign_speakers']}) a join ({sql("segments", " select recording_id, seg_no, start_ms from segments")}) x using (recording_id, seg_no)) s
   on p.recording_id=s.recording_id and p.start_ms=s.start_ms""")
def _(spark, sf):
    """Pieces of a turn each, some delivered twice, and turns; against the SQL of the stored paragraphs and speakers."""
    p = _pieces(spark, sf)
    twice = p.unionByName(p.where("piece_no % 3 = 1"))
    out = drained(live.live_job(streamed(materialise(twice)), streamed(_turn_rows(spark, sf)))).where("recording_id >= 0")
    def ms(c):
        return F.unix_millis(c) - 1_767_225_600_000
    return out.select("recording_id", ms("started").alias("start_ms"), ms("ended").alias("end_ms"), "speaker", tx.clean_text(F.col("text")).alias("text"))


def _pieces(spark, sf):
    s = fx.segments(spark, sf)
    p = s.groupBy("recording_id", F.col("turn").alias("piece_no")).agg(F.min("start_ms").alias("piece_start_ms"), F.sort_array(F.collect_list(F.struct("seg_no", "text", "start_ms", "end_ms"))).alias("_s"))
    none = F.array().cast("array<struct<word:string,start_ms:bigint,end_ms:bigint>>")
    at = F.col("piece_start_ms")
    return p.select("recording_id", "piece_no", "piece_start_ms", F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("started_at"), F.transform("_s", lambda x: F.struct(
        x["text"].alias("text"), (x["start_ms"] - at).alias("start_ms"), (x["end_ms"] - at).alias("end_ms"), none.alias("words"))).alias("segments"))


@query("live_voices")
def _(spark, sf):
    v = fx.voices(spark, sf).select("recording_id", "seg_no", F.col("vector").cast("array<double>").alias("vector"),
                                    F.when(F.col("seg_no") < 30, F.col("speaker")).alias("learned"))
    return drained(live.live_voices(streamed(v))).where("recording_id >= 0")
