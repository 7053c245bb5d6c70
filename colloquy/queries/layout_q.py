"""Layout and speakers over the fixture recordings."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import ORACLES, query
from colloquy.fixtures import sql
from colloquy.functions import text as tx
from colloquy.operators import layout as lo
from colloquy.operators import speakers as sp
from colloquy.queries.sentences_sql import SENTENCES

_CLOCK = """case when {0}//3600000>0 then ({0}//3600000)||':'||lpad((({0}//60000)%60)::VARCHAR,2,'0')||':'||lpad((({0}//1000)%60)::VARCHAR,2,'0')
  else ({0}//60000)||':'||lpad((({0}//1000)%60)::VARCHAR,2,'0') end"""
_CLEAN = "regexp_replace(trim(regexp_replace({},'\\s+',' ','g')),' ([,.;:!?…])','\\1','g')"


@query("assign_speakers", sql("segments turns", """,
 o as (select s.recording_id, s.seg_no, t.speaker, row_number() over (partition by s.recording_id, s.seg_no
        order by least(s.end_ms,t.turn_end_ms)-greatest(s.start_ms,t.turn_start_ms) desc, t.turn) as rn
   from segments s join turns t on s.recording_id=t.recording_id and s.start_ms<t.turn_end_ms and s.end_ms>t.turn_start_ms),
 f as (select recording_id, arg_min(speaker, turn) as opening from turns group by recording_id)
 select s.recording_id, s.seg_no, coalesce(last_value(o.speaker ignore nulls) over (partition by s.recording_id order by s.seg_no
    rows between unbounded preceding and current row), f.opening, 'SPEAKER_00') as speaker
 from segments s left join o on s.recording_id=o.recording_id and s.seg_no=o.seg_no and o.rn=1
 left join f on s.recording_id=f.recording_id"""))
def _(spark, sf):
    return sp.assign_speakers(fx.segments(spark, sf), fx.turns(spark, sf)).select("recording_id", "seg_no", "speaker")


def _names(spark, sf):
    """Names for the labels of each recording: a blank one for every third recording's user."""
    s = fx.segments(spark, sf).select("recording_id", "speaker").distinct()
    r = F.col("recording_id")
    return s.withColumn("name", F.when((r % 3 == 0) & (F.col("speaker") == "user"), F.lit("  "))
                        .when(F.col("speaker") == "system", F.lit("Anna"))
                        .otherwise(F.concat(F.lit(" Voice "), (r % 7).cast("string"), F.lit(" "))))


@query("rename_speakers", sql("segments", """
 select recording_id, seg_no, speaker as label, case when recording_id%3=0 and speaker='user' then speaker
   when speaker='system' then 'Anna' else 'Voice '||(recording_id%7) end as speaker from segments"""))
def _(spark, sf):
    return sp.rename_speakers(fx.segments(spark, sf), _names(spark, sf)).select("recording_id", "seg_no", "label", "speaker")


@query("restore_clock", sql("segments turns", """,
 p0 as (select *, turn_end_ms-turn_start_ms as len from turns),
 p as (select recording_id, turn, sum(len) over w as upto, turn_start_ms-(sum(len) over w - len) as shift from p0
    window w as (partition by recording_id order by turn)),
 e as (select recording_id, max(upto) as mx, arg_max(shift, turn) as ls from p group by recording_id),
 c as (select s.recording_id, s.seg_no as id, s.start_ms as at_ms, p.shift,
    row_number() over (partition by s.recording_id, s.seg_no order by p.turn) as rn
    from segments s join p on s.recording_id=p.recording_id and p.upto>=s.start_ms)
 select s.recording_id, s.seg_no as id, s.start_ms as at_ms, (s.start_ms+coalesce(c.shift, e.ls))::BIGINT as real_ms
 from segments s join e on s.recording_id=e.recording_id left join c on s.recording_id=c.recording_id and s.seg_no=c.id and c.rn=1"""))
def _(spark, sf):
    t = fx.turns(spark, sf).select("recording_id", F.col("turn").alias("part_no"), F.col("turn_start_ms").alias("start_ms"),
                                   F.col("turn_end_ms").alias("end_ms"))
    times = fx.segments(spark, sf).select("recording_id", F.col("seg_no").alias("id"), F.col("start_ms").alias("at_ms"))
    return sp.restore_clock(times, t)


def _six(x):
    """To six digits as SQL rounds, which leaves a small negative number its sign: -0.0."""
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


@query("learn_voices", sql("voices", """,
 n as (select recording_id, seg_no, speaker, vector, sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE*x::DOUBLE))) as nn from voices where seg_no<30),
 d as (select recording_id, speaker, unnest(vector)::DOUBLE/nn as x, generate_subscripts(vector,1) as dim from n),
 g as (select recording_id, speaker, dim, sum(x) as x, count(*) as n from d group by all)
 select recording_id, speaker, list(round(x,6) order by dim) as sum_vec, max(n) as n from g group by recording_id, speaker"""))
def _(spark, sf):
    v = sp.learn_voices(fx.voices(spark, sf).where("seg_no < 30"))
    return v.withColumn("sum_vec", F.transform("sum_vec", _six))


@query("match_voices", sql("voices", """,
 n as (select recording_id, seg_no, speaker, list_transform(vector, lambda x: x::DOUBLE) as v from voices),
 u as (select recording_id, seg_no, speaker, list_transform(v, lambda x: x/sqrt(list_sum(list_transform(v, lambda y: y*y)))) as u from n),
 d as (select recording_id, speaker, unnest(u) as x, generate_subscripts(u,1) as dim from u where seg_no<30),
 g as (select recording_id, speaker, dim, sum(x) as x from d group by all),
 c as (select recording_id, speaker, list(x order by dim) as c from g group by all),
 m as (select u.recording_id, u.seg_no, c.speaker, list_dot_product(u.u, c.c)/sqrt(list_dot_product(c.c, c.c)) as cosine
    from u join c on u.recording_id=c.recording_id where u.seg_no>=30),
 r as (select *, row_number() over (partition by recording_id, seg_no order by cosine desc, speaker desc) as rn from m)
 select recording_id, seg_no, speaker, round(cosine, 6) as likeness from r where rn=1"""))
def _(spark, sf):
    v = fx.voices(spark, sf)
    learned = sp.learn_voices(v.where("seg_no < 30"))
    return sp.match_voices(v.where("seg_no >= 30"), learned, fixed=True).withColumn("likeness", F.round("likeness", 6))


@query("learn_all_voices", ORACLES["learn_voices"].replace(" where seg_no<30", ""))
def _(spark, sf):
    v = sp.learn_voices(fx.voices(spark, sf))
    return v.withColumn("sum_vec", F.transform("sum_vec", _six))


@query("match_all_voices", ORACLES["match_voices"].replace(" where seg_no<30", "").replace(" where u.seg_no>=30", ""))
def _(spark, sf):
    """Every stretch against the voices of all of them."""
    v = fx.voices(spark, sf)
    return sp.match_voices(v, sp.learn_voices(v), fixed=True).withColumn("likeness", F.round("likeness", 6))


@query("match_voices_open")
def _(spark, sf):
    v = fx.voices(spark, sf)
    learned = sp.learn_voices(v.where("speaker < 'SPEAKER_05'"))
    return sp.match_voices(v, learned).withColumn("likeness", F.round("likeness", 6))


@query("speakers_in_order", sql("segments", """
 select recording_id, speaker, first_seg, row_number() over (partition by recording_id order by first_seg) as ord from
 (select recording_id, speaker, min(seg_no) as first_seg from segments group by all)"""))
def _(spark, sf):
    return sp.speakers_in_order(fx.segments(spark, sf))


@query("first_lines", sql("segments", """select recording_id, speaker, arg_min(text, seg_no) as line
  from segments where trim(text)<>'' group by recording_id, speaker"""))
def _(spark, sf):
    return sp.first_lines(fx.segments(spark, sf))


@query("recording_stats", sql("segments", """select recording_id,
  sum(len(string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ')))::BIGINT as words, count(*) as segments,
  max(end_ms) as duration_ms, count(distinct speaker) as speakers from segments group by recording_id"""))
def _(spark, sf):
    return sp.recording_stats(fx.segments(spark, sf))


@query("early_and_late", sql("segments turns", """,
 o as (select s.recording_id, s.seg_no, t.speaker, row_number() over (partition by s.recording_id, s.seg_no
        order by least(s.end_ms,t.turn_end_ms)-greatest(s.start_ms,t.turn_start_ms) desc, t.turn) as rn
   from segments s join turns t on s.recording_id=t.recording_id and s.start_ms<t.turn_end_ms and s.end_ms>t.turn_start_ms),
 f as (select recording_id, arg_min(speaker, turn) as opening from turns group by recording_id),
 a as (select s.recording_id, s.seg_no, s.start_ms, s.speaker as own, coalesce(last_value(o.speaker ignore nulls) over (partition by s.recording_id order by s.seg_no
    rows between unbounded preceding and current row), f.opening, 'SPEAKER_00') as speaker
 from segments s left join o on s.recording_id=o.recording_id and s.seg_no=o.seg_no and o.rn=1
 left join f on s.recording_id=f.recording_id)
 select recording_id, seg_no, case when start_ms<60000 then speaker else own end as speaker from a"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    early = sp.assign_speakers(s, fx.turns(spark, sf))
    return sp.early_and_late(early, s.select(*early.columns), learn_ms=60_000).select("recording_id", "seg_no", "speaker")


@query("close_open_ends", sql("segments", """,
 n as (select *, case when seg_no%4=1 then null else end_ms end as e0, case when seg_no%10=7 then null else start_ms end as s0 from segments),
 l as (select *, lead(s0) over (partition by recording_id order by seg_no) as nx, max(end_ms) over (partition by recording_id) as mx from n)
 select recording_id, seg_no, s0 as start_ms, coalesce(e0, nx, case when recording_id%2=0 then mx+1000 end) as end_ms from l
 where s0 is not null and coalesce(e0, nx, case when recording_id%2=0 then mx+1000 end) is not null"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    lengths = s.where("recording_id % 2 = 0").groupBy("recording_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))
    open_ = s.withColumns({"end_ms": F.when(F.col("seg_no") % 4 == 1, None).otherwise(F.col("end_ms")),
                           "start_ms": F.when(F.col("seg_no") % 10 == 7, None).otherwise(F.col("start_ms"))})
    return lo.close_open_ends(open_, lengths).select("recording_id", "seg_no", "start_ms", "end_ms")


@query("segments_from_words", sql("words", """,
 w as (select *, row_number() over (partition by recording_id order by seg_no, word_no) as n from words),
 step as (
  with recursive r as (
   select recording_id, n, word, start_ms, end_ms, start_ms as opened, length(word)+1 as width,
     regexp_matches(word, '[.!?…]+[\"''”»)\\]]*$') as stop, 0 as seg from w where n=1
   union all
   select w.recording_id, w.n, w.word, w.start_ms, w.end_ms,
     case when r.stop or w.start_ms-r.end_ms>600 or w.end_ms-r.opened>20000 or r.width>=400 then w.start_ms else r.opened end,
     case when r.stop or w.start_ms-r.end_ms>600 or w.end_ms-r.opened>20000 or r.width>=400 then length(w.word)+1 else r.width+length(w.word)+1 end,
     regexp_matches(w.word, '[.!?…]+[\"''”»)\\]]*$'),
     case when r.stop or w.start_ms-r.end_ms>600 or w.end_ms-r.opened>20000 or r.width>=400 then r.seg+1 else r.seg end
   from r join w on w.recording_id=r.recording_id and w.n=r.n+1)
  select * from r)
 select recording_id, seg::BIGINT as seg_no, regexp_replace(string_agg(word,' ' order by n),' ([,.;:!?…])','\\1','g') as text,
  arg_min(start_ms,n) as start_ms, arg_max(end_ms,n) as end_ms from step group by recording_id, seg"""))
def _(spark, sf):
    return lo.segments_from_words(fx.words(spark, sf)).drop("words")


@query("paragraphs", sql("segments", """,
 w as (select *, lead(start_ms) over (partition by recording_id order by seg_no)-end_ms as gap from segments),
 step as (
  with recursive r as (
   select recording_id, seg_no, text, length(text) as width, (gap is null or gap>1200 or length(text)>=600) as stop, 0 as para, start_ms, end_ms from w where seg_no=0
   union all
   select w.recording_id, w.seg_no, w.text, case when r.stop then length(w.text) else r.width+1+length(w.text) end,
     (w.gap is null or w.gap>1200 or (case when r.stop then length(w.text) else r.width+1+length(w.text) end)>=600),
     case when r.stop then r.para+1 else r.para end, w.start_ms, w.end_ms
   from r join w on w.recording_id=r.recording_id and w.seg_no=r.seg_no+1)
  select * from r)
 select recording_id, para::BIGINT as para_no, """ + _CLEAN.format("string_agg(text,' ' order by seg_no)") + """ as text,
  min(start_ms) as start_ms, max(end_ms) as end_ms from step group by recording_id, para"""))
def _(spark, sf):
    return lo.paragraphs(fx.segments(spark, sf))


@query("dialogue", sql("segments", """,
 l as (select *, case when lag(speaker) over (partition by recording_id order by seg_no)=speaker then 0 else 1 end as fresh from segments),
 i as (select *, sum(fresh) over (partition by recording_id order by seg_no)-1 as turn_no from l)
 select recording_id, turn_no::BIGINT as turn_no, 0::BIGINT as part, min(speaker) as speaker,
  '['||min(speaker)||'] '||""" + _CLEAN.format("string_agg(text,' ' order by seg_no)") + """ as text from i group by recording_id, turn_no"""))
def _(spark, sf):
    return lo.dialogue(fx.segments(spark, sf))


@query("prompt_text", sql("segments", f"""
 select recording_id, seg_no, '['||{_CLOCK.format('start_ms')}||'] '||
  case when lag(speaker) over (partition by recording_id order by seg_no)=speaker then '' else speaker||': ' end||text as line from segments"""))
def _(spark, sf):
    return lo.prompt_text(fx.segments(spark, sf))


def _paras(spark, sf):
    return lo.paragraphs_of_prose(fx.prose(spark, sf))


@query("transcript_blocks", sql("segments prose", f""",
 {SENTENCES},
 p as (select recording_id, n//5 as para_no, string_agg(text,' ' order by n) as text from sents group by recording_id, n//5)
 select recording_id, seg_no as block_no, start_ms, {_CLOCK.format('start_ms')} as clock, speaker||': '||text as body from segments
 union all select recording_id, para_no, null, '', text from p where recording_id not in (select recording_id from segments)"""))
def _(spark, sf):
    return lo.transcript_blocks(fx.segments(spark, sf), _paras(spark, sf))


@query("timed_or_prose", sql("segments prose", """
 select recording_id, seg_no, text, start_ms, end_ms, speaker from segments
 union all select recording_id, 0, text, null, null, null from prose where recording_id not in (select recording_id from segments)"""))
def _(spark, sf):
    return lo.timed_or_prose(fx.segments(spark, sf), fx.prose(spark, sf))
