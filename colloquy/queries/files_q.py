"""Sound, and what is stored in files, over the fixtures."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql
from colloquy.operators import audio as au
from colloquy.operators import subtitles as st
from colloquy.queries.subtitles_q import one_cue_each
from colloquy.sources import readers as rd
from colloquy.sources import sinks as sk


@query("loudness", sql("frames", """,
 n as (select recording_id, max(frame_no)+1 as n from frames group by all),
 s as (select f.recording_id, ((frame_no+1)*least(20,n)-1)//n as slice_no, sample from frames f join n using (recording_id))
 select recording_id, slice_no, round_even(least(greatest(sqrt(avg(sample*sample)),0),1)*1000,0)::INT as level from s group by all"""))
def _(spark, sf):
    return au.loudness(fx.frames(spark, sf).withColumnRenamed("frame_no", "sample_no"), 20)


@query("quietest_cut", sql("frames", """,
 p as (select recording_id, frame_no//60 as piece_no, frame_no%60 as k, sample*sample as e from frames),
 w as (select *, round(sum(e) over (partition by recording_id, piece_no order by k rows between 7 preceding and 7 following)/15,12) as s from p where k>=30),
 b as (select recording_id, piece_no, arg_min(k, (s,k)) as c from w group by all),
 n as (select recording_id, piece_no, max(k)+1 as n from p group by all)
 select n.recording_id, n.piece_no, coalesce(c, least(n, 60)) as cut_frame from n left join b using (recording_id, piece_no)"""))
def _(spark, sf):
    f = fx.frames(spark, sf).select("recording_id", F.floor(F.col("frame_no") / 60).alias("piece_no"), (F.col("frame_no") % 60).alias("frame_in_piece"),
                                    (F.col("sample") * F.col("sample")).alias("energy"))
    return au.quietest_cut(f, 30, 60)


def _framed(spark, sf):
    f = fx.frames(spark, sf)
    return f.groupBy("recording_id", F.floor(F.col("frame_no") / 4).alias("frame_no")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("frame_no", "sample"))), lambda x: x["sample"]).alias("samples"))


@query("mix_frames", sql("frames", """,
 g as (select recording_id, frame_no//4 as fr, list(sample order by frame_no) as a from frames group by all),
 o as (select recording_id, fr, a as o from g where fr%2=0)
 select recording_id, fr as frame_no, list_transform(list_zip(a, list_resize(coalesce(o,[]), len(a), 0.0)), lambda z: round(z[1]+coalesce(z[2],0),6)) as samples
 from g left join o using (recording_id, fr)"""))
def _(spark, sf):
    f = _framed(spark, sf)
    m = au.mix_frames(f, f.where("frame_no % 2 = 0"))
    return m.withColumn("samples", F.transform("samples", lambda x: F.round(x, 6)))


@query("frame_energy", sql("frames", """
 select recording_id, frame_no//4 as frame_no, round(sum(sample*sample)/count(*),9) as energy, round(case when sum(sample*sample)>0 then 10*log10(sum(sample*sample)/count(*)) else -120 end,6) as db from frames group by all"""))
def _(spark, sf):
    e = au.energy(_framed(spark, sf))
    return e.select("recording_id", "frame_no", F.round("energy", 9).alias("energy"), F.round(au.rms_db(F.col("energy")), 6).alias("db"))


@query("segments_json_round_trip", sql("segments", "select recording_id::VARCHAR as recording_id, seg_no, text, start_ms, end_ms, speaker from segments"))
def _(spark, sf):
    s = fx.segments(spark, sf).withColumn("recording_id", F.col("recording_id").cast("string"))
    return rd.parse_segments(sk.segments_json(s)).drop("words")


@query("subtitles_round_trip", sql("segments", "select recording_id, seg_no, text, start_ms, end_ms, speaker from segments"))
def _(spark, sf):
    """SRT written with a named voice on every cue, and read back."""
    c = one_cue_each(spark, sf)
    named = c.withColumn("lines", F.array(F.concat(F.lit("["), "speaker", F.lit("] "), F.element_at("lines", 1))))
    blocks = st.export_subtitles(named)
    # The fixture's recordings are a few minutes long: here a file is one row.
    files = blocks.groupBy("recording_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("cue_no", "block"))), lambda x: x["block"]), "\n").alias("value"))
    return rd.parse_subtitles(files)


@query("decode_text", "select doc_id, text from documents")
def _(spark, sf):
    """Half of the documents in UTF-8, half in Latin-1 where that can hold them."""
    d = fx.table(spark, sf, "documents")
    latin = F.encode("text", "ISO-8859-1")
    fits = F.decode(latin, "ISO-8859-1") == F.col("text")
    content = F.when((F.col("doc_id") % 2 == 0) & fits, latin).otherwise(F.encode("text", "UTF-8"))
    return d.select("doc_id", rd.decode_text(content).alias("text"))
