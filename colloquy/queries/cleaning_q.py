"""Cleaning: invented phrases, credits, doublings, duplicates."""

import re

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql
from colloquy.functions import lexicons as lx
from colloquy.operators import clean as cl

_BASE = ["recording_id", "seg_no", "text", "start_ms", "end_ms", "speaker"]
_KEY = "trim(regexp_replace(lower({}),'[^\\p{{L}}\\p{{N}}_\\s]','','g'))"
_PHRASES = "(values " + ",".join("('" + p.replace("'", "''") + "')" for p in cl.ALL_PHRASES) + ") p(key)"


def sql_keys(words):
    return f"list_transform({words}, lambda x: regexp_replace(lower(x),'[^\\p{{L}}\\p{{N}}_]','','g'))"


@query("phrase_catalogue_union", sql("invented", f"""select key, count(*) as segments from
  (select {_KEY.format('text')} as key from invented) where key in (select key from {_PHRASES}) group by key"""))
def _(spark, sf):
    keyed = cl.normalise_text(fx.invented(spark, sf)).select("key")
    # One set over both languages, counted against the corpus.
    return keyed.join(F.broadcast(lx.phrases(spark)), "key").groupBy("key").agg(F.count("*").alias("segments"))


@query("normalise_text", sql("segments", f"""select recording_id, seg_no,
  regexp_replace(trim(regexp_replace(text,'\\s+',' ','g')),' ([,.;:!?…])','\\1','g') as text_clean,
  {_KEY.format('text')} as key,
  {sql_keys("string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ')")} as word_keys from segments"""))
def _(spark, sf):
    return cl.normalise_text(fx.segments(spark, sf)).select("recording_id", "seg_no", "text_clean", "key", "word_keys")


@query("drop_invented_segments", sql("invented", f"""select recording_id, seg_no, text, start_ms, end_ms, speaker
  from invented where {_KEY.format('text')} not in (select key from {_PHRASES})"""))
def _(spark, sf):
    return cl.drop_invented_segments(fx.invented(spark, sf), lx.phrases(spark)).select(*_BASE)


_HEAD = cl._edge_pattern(cl.ALL_PHRASES, False).replace("\\ ", " ").replace("'", "''")
_TAIL = cl._edge_pattern(cl.ALL_PHRASES, True).replace("\\ ", " ").replace("'", "''")


@query("strip_edge_phrases", sql("invented", f""",
 k as (select *, string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ') as ws from invented),
 h as (select *, {sql_keys('ws')} as ks from k),
 h2 as (select *, regexp_extract(array_to_string(ks,' ')||' ', '{_HEAD}', 0) as hit from h),
 h3 as (select *, (length(hit)-length(replace(hit,' ','')))::INT as head_cut from h2),
 t as (select *, list_slice(ws, head_cut+1, len(ws)) as ws2, list_slice(ks, head_cut+1, len(ks)) as ks2 from h3),
 t2 as (select *, case when len(ks2)=0 then '' else regexp_extract(array_to_string(list_reverse(ks2),' ')||' ', '{_TAIL}', 0) end as hit2 from t),
 t3 as (select *, (length(hit2)-length(replace(hit2,' ','')))::INT as tail_cut from t2)
 select recording_id, seg_no, head_cut, tail_cut, array_to_string(list_slice(ws2,1,len(ws2)-tail_cut),' ') as left_text from t3"""))
def _(spark, sf):
    s = cl.strip_edge_phrases(cl.with_words(fx.invented(spark, sf)))
    return s.select("recording_id", "seg_no", "head_cut", "tail_cut",
                    F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("left_text"))


@query("cut_credits")
def _(spark, sf):
    return cl.cut_credits(cl.with_words(fx.invented(spark, sf))).select(
        "recording_id", "seg_no", "credit_cut", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("left_text"))


@query("trim_overlap")
def _(spark, sf):
    return cl.trim_overlap(cl.with_words(fx.doubled(spark, sf))).select(
        "recording_id", "seg_no", "overlap_cut", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("left_text"))


@query("collapse_repeats")
def _(spark, sf):
    return cl.collapse_repeats(cl.with_words(fx.doubled(spark, sf))).select(
        "recording_id", "seg_no", "repeat_cut", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("left_text"))


@query("dedupe_neighbours", sql("doubled", f""",
 k as (select *, {_KEY.format('text')} as key from doubled),
 l as (select *, lag(key) over (partition by recording_id order by seg_no) as prev from k),
 f as (select *, case when key<>'' and (key=prev or (length(key)>40 and prev<>'' and (contains(prev,key) or contains(key,prev)))) then 0 else 1 end as fresh from l),
 i as (select *, sum(fresh) over (partition by recording_id order by seg_no) as island from f),
 r as (select *, row_number() over (partition by recording_id, island order by length(text) desc, seg_no) as rn from i)
 select recording_id, seg_no, text, start_ms, end_ms, speaker from r where rn=1"""))
def _(spark, sf):
    return cl.dedupe_neighbours(fx.doubled(spark, sf)).select(*_BASE)


@query("job_clean")
def _(spark, sf):
    return cl.clean(fx.invented(spark, sf), lx.phrases(spark)).select(*_BASE)
