"""Subtitles over the fixture recordings."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql
from colloquy.operators import subtitles as st

NETFLIX = st.choose(["netflix"])
ALL = st.presets()
STRONG = "'[.!?;:]+[\"''”»)\\]]*$'"


def one_cue_each(spark, sf, specs=NETFLIX):
    """One cue per segment, timed as spoken: input for the checks alone."""
    s = fx.segments(spark, sf)
    return st.with_next_start(s.select(
        "recording_id", F.explode(F.array(*[F.lit(n) for n in specs])).alias("preset"), (F.col("seg_no") + 1).alias("cue_no"),
        "start_ms", "end_ms", F.array("text").alias("lines"), "speaker"))


def sql_specs(specs):
    rows = []
    for n, p in specs.items():
        g = lambda k, d="null": st.limit(p, k, d)
        rows.append(f"('{n}',{g('max_chars_per_line',42)},{g('max_lines',2)},{g('max_chars_per_second')},"
                    f"{g('max_words_per_minute')}::INT,{g('min_duration_ms',0)},{g('max_duration_ms',7000)},{g('min_gap_ms',0)},"
                    f"{g('gap_chaining.snap_below_ms',0)},{g('gap_chaining.snap_to_ms', g('min_gap_ms',0))})")
    return " specs(preset,cpl,lines_max,cps_max,wpm_max,dmin,dmax,gmin,snap_below,snap_to) as (values " + ",".join(rows) + ")"


def lint_sql(specs):
    return f""",
 {sql_specs(specs)},
 c as (select s.recording_id, p.*, seg_no+1 as cue_no, start_ms, end_ms, end_ms-start_ms as dur, text,
   lead(start_ms) over (partition by recording_id, preset order by seg_no)-end_ms as gap,
   len(string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ')) as nw from segments s, specs p),
 lint as (
 select recording_id, preset, cue_no, 'empty' as kind, 0::DOUBLE as value from c where trim(text)=''
 union all select recording_id, preset, cue_no, 'backwards', 0 from c where dur<=0
 union all select recording_id, preset, cue_no, 'too_wide', length(text) from c where length(text)>cpl
 union all select recording_id, preset, cue_no, 'too_many_lines', 1 from c where 1>lines_max
 union all select recording_id, preset, cue_no, 'too_short', dur from c where dmin>0 and dur<dmin-1
 union all select recording_id, preset, cue_no, 'too_long', dur from c where dur>dmax+1
 union all select recording_id, preset, cue_no, 'too_fast', round(length(text)*1000.0::DOUBLE/dur,1) from c where length(text)*1000.0::DOUBLE/dur>cps_max
 union all select recording_id, preset, cue_no, 'too_many_words', floor(nw*60000.0::DOUBLE/dur) from c where nw*60000.0::DOUBLE/dur>wpm_max
 union all select recording_id, preset, cue_no, 'overlap', gap from c where gap<-1
 union all select recording_id, preset, cue_no, 'gap_too_small', gap from c where gap>=-1 and gmin>0 and gap<gmin-1)
"""


@query("lint_cues", sql("segments", lint_sql(NETFLIX) + "select * from lint"))
def _(spark, sf):
    return st.lint_cues(one_cue_each(spark, sf), NETFLIX)


@query("apply_presets", sql("segments", lint_sql(ALL) + """
 select preset, kind, count(*) as remarks, count(distinct recording_id) as recordings from lint group by preset, kind"""))
def _(spark, sf):
    remarks = st.lint_cues(one_cue_each(spark, sf, ALL), ALL)
    return remarks.groupBy("preset", "kind").agg(F.count("*").alias("remarks"), F.count_distinct("recording_id").alias("recordings"))


_GROUP = """case when kind in ('too_fast','too_many_words') then 'speech' when kind in
  ('too_short','too_long','overlap','gap_too_small','backwards') then 'timing' else 'layout' end"""


@query("tally_problems", sql("segments", lint_sql(NETFLIX) + f"""
 , t as (select preset, {_GROUP} as "group", kind from lint)
 select preset, "group", kind, count(*) as remarks from t group by rollup(preset, "group", kind)"""))
def _(spark, sf):
    return st.tally_problems(st.lint_cues(one_cue_each(spark, sf), NETFLIX))


@query("slice", sql("segments", lint_sql(NETFLIX) + """
 , w as (select recording_id, speaker, sum(len(string_split(trim(regexp_replace(text,'\\s+',' ','g')),' ')))::BIGINT as words,
    sum(end_ms-start_ms)::BIGINT as spoken_ms from segments group by all),
 f as (select l.recording_id, s.speaker, count(*) as too_fast from lint l join segments s on l.recording_id=s.recording_id
    and l.cue_no=s.seg_no+1 where l.kind='too_fast' group by all)
 select w.*, coalesce(f.too_fast,0) as too_fast from w left join f using (recording_id, speaker)"""))
def _(spark, sf):
    """For every recording: who said how much, and how many of their cues are too fast to read."""
    from colloquy.functions import text as tx
    s = fx.segments(spark, sf)
    said = s.groupBy("recording_id", "speaker").agg(
        F.sum(F.size(tx.words(F.col("text"))).cast("long")).alias("words"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"))
    cues = one_cue_each(spark, sf)
    fast = (st.lint_cues(cues, NETFLIX).where("kind = 'too_fast'")
            .join(cues.select("recording_id", "cue_no", "speaker"), ["recording_id", "cue_no"])
            .groupBy("recording_id", "speaker").agg(F.count("*").alias("too_fast")))
    return said.join(fast, ["recording_id", "speaker"], "left").fillna(0, ["too_fast"])


@query("interpolate_words", sql("words", "select recording_id, seg_no, word_no, word, start_ms, end_ms from words"))
def _(spark, sf):
    return st.interpolate_words(fx.segments(spark, sf)).drop("speaker")


_NUMBERED = """,
 w as (select *, row_number() over (partition by recording_id order by seg_no, word_no)-1 as n,
   case when lag(speaker) over o is null then 0 when lag(speaker) over o<>speaker or regexp_matches(lag(word) over o, """ + STRONG + """) then 1 else 0 end as fresh
   from words window o as (partition by recording_id order by seg_no, word_no)),
 g as (select *, sum(fresh) over (partition by recording_id order by n)::BIGINT as group_no from w)"""


@query("sentence_groups", sql("words", _NUMBERED + "select recording_id, n, group_no from g"))
def _(spark, sf):
    return st.sentence_groups(fx.words(spark, sf)).select("recording_id", "n", "group_no")


@query("cut_cues")
def _(spark, sf):
    c = st.cut_cues(fx.words(spark, sf), NETFLIX, "en")
    return c.select("recording_id", "cue_start", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"), "first_ms", "last_ms")


KARAOKE = st.choose(["social_karaoke"])


@query("cut_cues_by_words", sql("words", """,
 w as (select *, row_number() over (partition by recording_id order by seg_no, word_no)-1 as n from words),
 step as (with recursive r as (
   select recording_id, n, word, 1 as cnt, length(word) as width, n as cue_start from w where n=0
   union all
   select w.recording_id, w.n, w.word, case when r.cnt>=4 or r.width+1+length(w.word)>20 then 1 else r.cnt+1 end,
    case when r.cnt>=4 or r.width+1+length(w.word)>20 then length(w.word) else r.width+1+length(w.word) end,
    case when r.cnt>=4 or r.width+1+length(w.word)>20 then w.n else r.cue_start end
   from r join w on w.recording_id=r.recording_id and w.n=r.n+1) select * from r)
 select recording_id, cue_start, string_agg(word, ' ' order by n) as text from step group by recording_id, cue_start"""))
def _(spark, sf):
    c = st.cut_cues(fx.words(spark, sf), KARAOKE)
    return c.select("recording_id", "cue_start", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("text"))


@query("wrap_lines")
def _(spark, sf):
    c = st.wrap_lines(st.cut_cues(fx.words(spark, sf), NETFLIX, "en"), NETFLIX)
    return c.select("recording_id", "cue_start", "lines")


def segment_cues(spark, sf, specs=NETFLIX):
    """Each segment as a cue not yet timed."""
    s = fx.segments(spark, sf)
    return st.number_cues(s.select("recording_id", F.lit(next(iter(specs))).alias("preset"), F.col("seg_no").alias("cue_start"),
                                   F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"), "speaker", F.array("text").alias("lines")))


_TIMED = """,
 c as (select recording_id, seg_no, start_ms as f, end_ms as l, lead(start_ms) over (partition by recording_id order by seg_no)-83 as ceil from segments),
 step as (with recursive r as (
   select recording_id, seg_no, greatest(0, f-100) as s, {end0} as e from (select *, greatest(0,f-100) as s from c where seg_no=0)
   union all
   select recording_id, seg_no, s, {end0} from (select c.*, greatest(0, c.f-100, r.e+83) as s from r join c on c.recording_id=r.recording_id and c.seg_no=r.seg_no+1))
   select * from r)"""
_E1 = "greatest(least(l+500, coalesce(ceil,1e15)), least(l+200, coalesce(ceil,1e15)))"
_E2 = f"(case when {_E1}-s<833 then least(s+833, coalesce(ceil,1e15)) else {_E1} end)"
_E3 = f"least({_E2}, s+7000)"
_TIMED = _TIMED.replace("{end0}", f"(case when {_E3}<=s then s+833 else {_E3} end)::BIGINT")


@query("time_cues", sql("segments", _TIMED + "select recording_id, seg_no+1 as cue_no, s as start_ms, e as end_ms from step"))
def _(spark, sf):
    return st.time_cues(segment_cues(spark, sf), NETFLIX).select("recording_id", "cue_no", "start_ms", "end_ms")


@query("chain_gaps", sql("segments", """
 , c as (select *, lead(start_ms) over (partition by recording_id order by seg_no) as nx from segments)
 select recording_id, seg_no+1 as cue_no, start_ms, case when nx-end_ms>=0 and nx-end_ms<458 then greatest(start_ms+200, nx-83) else end_ms end as end_ms from c"""))
def _(spark, sf):
    return st.chain_gaps(one_cue_each(spark, sf), NETFLIX).select("recording_id", "cue_no", "start_ms", "end_ms")


@query("mark_voices", sql("segments", """
 , c as (select *, lag(speaker) over (partition by recording_id order by seg_no) as pv, min(speaker) over (partition by recording_id)<>max(speaker) over (partition by recording_id) as several from segments)
 select recording_id, seg_no+1 as cue_no, case when (pv is null and several) or pv<>speaker then '- ' else '' end||text as line from c"""))
def _(spark, sf):
    return st.mark_voices(segment_cues(spark, sf)).select("recording_id", "cue_no", F.element_at("lines", 1).alias("line"))


def _stamp(c, sep):
    return (f"lpad(({c}//3600000)::VARCHAR,2,'0')||':'||lpad((({c}//60000)%60)::VARCHAR,2,'0')||':'||"
            f"lpad((({c}//1000)%60)::VARCHAR,2,'0')||'{sep}'||lpad(({c}%1000)::VARCHAR,3,'0')")


def _block(sep):
    return f"(seg_no+1)||chr(10)||{_stamp('start_ms', sep)}||' --> '||{_stamp('end_ms', sep)}||chr(10)||text||chr(10)"


@query("export_srt", sql("segments", f"select recording_id, seg_no+1 as cue_no, {_block(',')} as block from segments"))
def _(spark, sf):
    return st.export_subtitles(one_cue_each(spark, sf)).drop("preset")


@query("export_vtt", sql("segments", f"""select recording_id, seg_no+1 as cue_no, {_block('.')} as block from segments
  union all select distinct recording_id, 0, 'WEBVTT'||chr(10) from segments"""))
def _(spark, sf):
    return st.export_subtitles(one_cue_each(spark, sf), "vtt").drop("preset")


@query("job_subtitle")
def _(spark, sf):
    c = st.subtitle(fx.segments(spark, sf), NETFLIX, "en", mark_speakers=True)
    return c.select("recording_id", "cue_no", "start_ms", "end_ms", "lines")


@query("job_subtitle_report")
def _(spark, sf):
    return st.tally_problems(st.lint_cues(st.subtitle(fx.segments(spark, sf), ALL, "en"), ALL))
