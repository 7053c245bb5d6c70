"""Notes, sections and passes over the answers fixture."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql, sql_fold
from colloquy.functions import lexicons as lx
from colloquy.operators import callouts as co
from colloquy.operators import catalogue as ca
from colloquy.operators import metrics as me
from colloquy.operators import notes as no
from colloquy.operators import sections as se
from colloquy.operators import terms as tm
from colloquy.queries.summary_q import PROSE, ranked, sentences, terms_sql


@fx.written
def notes(spark, sf):
    return no.number_notes(no.parse_notes(fx.answers(spark, sf), lx.kinds(spark), "it"))


@fx.written
def note_weights(spark, sf):
    return tm.weights(notes(spark, sf), None, ("note_no",))


#: What the headings of the fixture mean to an Italian catalogue, which reads English too.
_ROUTED = "case h when 'Decisions' then 'decision' when 'Azioni' then 'action' when 'Open questions' then 'open_question' when 'Problem' then 'problem' end"

NOTES_SQL = """,
 l0 as (select recording_id, chunk_idx, span_start_ms, string_split(answer, chr(10)) as a from answers),
 l1 as (select recording_id, chunk_idx, span_start_ms, unnest(a) as line, generate_subscripts(a,1)-1 as line_no from l0),
 hd as (select recording_id, chunk_idx, substr(line, 4) as h from l1 where starts_with(line,'## ')),
 b0 as (select l1.*, """ + _ROUTED + """ as kind, trim(substr(line,3)) as b, regexp_extract(line,'`?[\\[(]?(\\d{1,3}:\\d{2}(?::\\d{2})?)[\\])]?`?',1) as ck
   from l1 join hd using (recording_id, chunk_idx) where starts_with(line,'- ')),
 b1 as (select *, trim(case when ck<>'' then regexp_replace(b,'^(.*?)`?[\\[(]?(\\d{1,3}:\\d{2}(?::\\d{2})?)[\\])]?`?(.*)$','\\1\\3') else b end) as b2,
   case when ck<>'' then (split_part(ck,':',1)::BIGINT*60+split_part(ck,':',2)::BIGINT)*1000 end as said from b0 where b<>''),
 nt as (select recording_id, chunk_idx, line_no, coalesce(kind,'fact') as type, trim(b2,' '||chr(9)||'-—–:•') as text,
   coalesce(last_value(said ignore nulls) over (partition by recording_id, chunk_idx order by line_no rows between unbounded preceding and current row), span_start_ms) as ts_start_ms from b1),
 notes as (select *, (row_number() over (partition by recording_id order by chunk_idx, line_no)-1)::BIGINT as note_no,
   'n'||substr(sha256(chunk_idx||chr(0)||ts_start_ms||chr(0)||substr(text,1,40)||chr(0)),1,10) as note_id from nt)"""


@query("parse_notes", sql("answers", NOTES_SQL + " select recording_id, chunk_idx, note_no, note_id, type, text, ts_start_ms from notes"))
def _(spark, sf):
    return notes(spark, sf).select("recording_id", "chunk_idx", "note_no", "note_id", "type", "text", "ts_start_ms")


@query("route_headings", sql("answers", NOTES_SQL + f""", n as (select h, count(*) as answers from hd group by h)
 select h as heading, {_ROUTED} as kind, answers from n"""))
def _(spark, sf):
    h = fx.answers(spark, sf).select(F.regexp_extract("answer", r"^## (.*)", 1).alias("heading"))
    n = h.groupBy("heading").agg(F.count("*").alias("answers"))
    return n.join(no.route_headings(h, lx.kinds(spark), "it"), "heading")


@query("unknown_headings", sql("answers", NOTES_SQL + " select distinct recording_id, chunk_idx, h as heading from hd where h='Weather'"))
def _(spark, sf):
    return no.unknown_headings(fx.answers(spark, sf), lx.kinds(spark), "it")


@query("clean_answers", sql("answers", """ , c as (select *, row_number() over (order by 1) as x from answers)
 select recording_id, chunk_idx, case when recording_id%4=2 then '' when recording_id%4=0 then substr(answer, strpos(answer, chr(10))+1) else answer end as answer from answers"""))
def _(spark, sf):
    r = F.col("recording_id")
    first = F.split_part("answer", F.lit("\n"), F.lit(1))
    a = fx.answers(spark, sf).select("recording_id", "chunk_idx", F.when(r % 4 == 0, F.concat(F.lit("Write  this:\n "), first)).otherwise("").alias("prompt"),
                                     F.when(r % 4 == 1, F.concat(F.lit("<think>so\nmuch</think>\n"), "answer"))
                                     .when(r % 4 == 2, F.concat(F.lit("Here it is\n-----BEGIN TRANSCRIPT-----\n"), "answer")).otherwise(F.col("answer")).alias("answer"))
    return no.clean_answers(a).select("recording_id", "chunk_idx", "answer")


_NTERMS = terms_sql("notes", "note_no")


@query("drop_example_copies", sql("answers", NOTES_SQL + ",\n" + _NTERMS + f""",
 s as (select recording_id, n, substr({sql_fold('term')},1,4) as stem, count(*) as c from terms group by all),
 z as (select recording_id, n, sum(c) as total from s group by all having sum(c)>=4),
 e as (select recording_id as line_no, n, stem from s where n=0 and recording_id<5),
 hit as (select s.recording_id, s.n, e.line_no, sum(s.c) as h from s join e using (stem) group by s.recording_id, s.n, e.line_no),
 gone as (select distinct hit.recording_id, hit.n from hit join z on hit.recording_id=z.recording_id and hit.n=z.n where h>=0.85*total)
 select recording_id, note_no from notes where (recording_id, note_no) not in (select (recording_id, n) from gone)"""))
def _(spark, sf):
    n = notes(spark, sf)
    examples = n.where("note_no = 0 and recording_id < 5").select(F.col("recording_id").alias("line_no"), "text")
    return no.drop_example_copies(n, examples).select("recording_id", "note_no")


@query("entities", sql("answers", NOTES_SQL + ",\n" + _NTERMS + """,
 d as (select distinct recording_id, n, term from terms), f as (select recording_id, term, count(*) as df from d group by all),
 r as (select d.*, row_number() over (partition by recording_id, n order by df desc, length(term) desc, term) as rn from d join f using (recording_id, term))
 select recording_id, n as note_no, list(term order by rn) as entities from r where rn<=4 group by recording_id, n"""))
def _(spark, sf):
    return no.entities(notes(spark, sf))


def _found_sql(pattern):
    return "list_transform(regexp_extract_all(t, '" + pattern.replace("'", "''") + "', 1), lambda x: trim(x))"


@query("enrich_notes", sql("answers", NOTES_SQL + f""",
 told as (select recording_id, note_no, '12 marzo '||text||' cost 30 euro by monday, 5%' as t from notes)
 select recording_id, note_no, {_found_sql(no.DATES)} as dates, {_found_sql(no.NUMBERS)} as numbers from told"""))
def _(spark, sf):
    n = notes(spark, sf).withColumn("text", F.concat(F.lit("12 marzo "), "text", F.lit(" cost 30 euro by monday, 5%")))
    return no.enrich_notes(n).select("recording_id", "note_no", "dates", "numbers")


@query("dedupe_notes")
def _(spark, sf):
    return se.dedupe_notes(notes(spark, sf), note_weights(spark, sf)).select("recording_id", "note_no", "text", "ts_start_ms")


@query("discover_sections")
def _(spark, sf):
    return se.discover_sections(notes(spark, sf), note_weights(spark, sf))


@query("section_keywords", sql("answers", NOTES_SQL + ",\n" + _NTERMS + """,
 d as (select distinct recording_id, n, term from terms), p as (select d.*, notes.type from d join notes on d.recording_id=notes.recording_id and d.n=notes.note_no),
 c as (select recording_id, type, term, count(*) as k from p group by all),
 r as (select *, row_number() over (partition by recording_id, type order by k desc, length(term) desc, term) as rn from c)
 select recording_id, type as section, list(term order by rn) as keywords from r where rn<=3 group by recording_id, type"""))
def _(spark, sf):
    return se.section_keywords(notes(spark, sf).withColumn("section", F.col("type")))


_PLACE = "case type " + " ".join(f"when '{k}' then {i}" for i, (k, _, _) in enumerate(lx.NOTE_KINDS)) + " end"


@query("route_sections", sql("answers", NOTES_SQL + f" select recording_id, note_no, {_PLACE}::BIGINT as section, type as kind from notes"))
def _(spark, sf):
    return se.route_sections(notes(spark, sf))


def placed(spark, sf):
    n = notes(spark, sf)
    p = se.assign_sections(n, note_weights(spark, sf), "hybrid")
    return p.join(n, ["recording_id", "note_no"])


@query("assign_sections")
def _(spark, sf):
    return placed(spark, sf).select("recording_id", "note_no", "part", "origin", "section", "kind")


@query("section_shape", sql("answers", NOTES_SQL + f""",
 p as (select recording_id, {_PLACE} as section, count(*) as n from notes group by all),
 s as (select recording_id, count(*) as sections, sum(n)::BIGINT as sections_kept, list(n order by n) as section_sizes, [] as tail_sizes, 0 as orphans from p group by recording_id)
 select *, 0 as notes_deduped from s"""))
def _(spark, sf):
    n = notes(spark, sf)
    fixed = se.assign_sections(n, mode="fixed")
    return se.section_shape(fixed, n)


@query("split_oversize")
def _(spark, sf):
    p = notes(spark, sf).withColumn("section", F.lit(0).cast("long"))
    return se.split_oversize(p).select("recording_id", "note_no", "section", "piece")


@query("label_sections", sql("answers", NOTES_SQL + ",\n" + _NTERMS + f""",
 d as (select distinct recording_id, n, term from terms),
 c as (select recording_id, n//5 as section, term, count(*) as k from d group by all),
 r as (select *, row_number() over (partition by recording_id, section order by k desc, length(term) desc, term) as rn from c),
 kw as (select recording_id, section, list(term order by rn) as kws from r where rn<=3 group by all),
 s as (select recording_id, note_no//5 as section, min(type) as type from notes group by all)
 select s.recording_id, s.section, case when s.section%3=0 then (case s.type {' '.join(f"when '{k}' then '{en}'" for k, en, _ in lx.NOTE_KINDS)} end) when s.section%3=1 then 'Other points'
   else upper(substr(kws[1],1,1))||lower(substr(kws[1],2))||coalesce(', '||kws[2],'')||coalesce(', '||kws[3],'') end as title from s left join kw using (recording_id, section)"""))
def _(spark, sf):
    n = notes(spark, sf).withColumn("section", F.floor(F.col("note_no") / 5))
    kw = se.section_keywords(n)
    s = n.groupBy("recording_id", "section").agg(F.min("type").alias("type")).join(kw, ["recording_id", "section"], "left")
    s = s.withColumn("kind", F.when(F.col("section") % 3 == 0, F.col("type")).when(F.col("section") % 3 == 1, "other"))
    # The operator calls a section without a kind or keywords "Other points"; the SQL gives it no title.
    titled = F.col("kind").isNotNull() | (F.size("keywords") > 0)
    return se.label_sections(s, lx.kinds(spark), "en").select("recording_id", "section", F.when(titled, F.col("title")).alias("title"))


@query("document_title", sql("answers", NOTES_SQL + """,
 t as (select recording_id, note_no, 'Topic '||substr(text,1,8) as title from notes),
 k as (select *, row_number() over (partition by recording_id order by note_no) as rn from t),
 g as (select recording_id, list(title order by rn) as ts from k where rn<=3 group by recording_id),
 r as (select distinct recording_id from segments)
 select r.recording_id, case when len(ts)>=2 then ts[1]||', '||lower(ts[2])||case when len(ts)>2 then ' and more' else '' end when len(ts)=1 then ts[1]
   when r.recording_id%2=0 then 'Rec '||r.recording_id else 'Summary of the recording' end as title from r left join g using (recording_id)"""))
def _(spark, sf):
    t = notes(spark, sf).select(
        "recording_id", F.col("note_no").alias("section_no"), F.concat(F.lit("Topic "), F.substring("text", 1, 8)).alias("title"), F.lit("model").alias("named_by"))
    r = fx.segments(spark, sf).select("recording_id").distinct()
    own = r.withColumn("title", F.when(F.col("recording_id") % 2 == 0, F.concat(F.lit("Rec "), "recording_id")).otherwise(""))
    return se.document_title(t, own, "en")


def _written(spark, sf):
    return fx.answers(spark, sf).select("recording_id", F.col("chunk_idx").alias("section_no"), F.col("answer").alias("body"))


@query("trim_repeated_bullets")
def _(spark, sf):
    return se.trim_repeated_bullets(_written(spark, sf))


@query("review_findings")
def _(spark, sf):
    """A stub reviewer that quotes two lines of every section and one that is not there."""
    w = _written(spark, sf)
    lines = F.split("body", "\n")
    said = w.withColumn("answer", F.concat(
        F.lit("INVENTED: "), F.get(lines, 1), F.lit("\nGARBLED - "), F.coalesce(F.get(lines, 2), F.lit("x")), F.lit("\nREPEATED: "),
        F.coalesce(F.get(lines, 3), F.lit("x")), F.lit("\nINVENTED: nothing of the sort was ever written")))
    return se.review_findings(said.select("recording_id", "section_no", "answer"), w)


@query("chunk_sentences", sql("segments", """,
 c as (select recording_id, seg_no as n, floor(length(text)/2.8::DOUBLE)::BIGINT+8 as cost from segments),
 step as (with recursive r as (
   select recording_id, n, cost, cost as size, n as chunk_start from c where n=0
   union all select c.recording_id, c.n, c.cost, case when r.size+c.cost>300 then c.cost else r.size+c.cost end,
     case when r.size+c.cost>300 then c.n else r.chunk_start end from r join c on c.recording_id=r.recording_id and c.n=r.n+1) select * from r)
 select recording_id, n as sent_no, chunk_start from step"""))
def _(spark, sf):
    s = fx.segments(spark, sf).withColumnRenamed("seg_no", "sent_no")
    return no.chunk_sentences(s, 300).select("recording_id", "sent_no", "chunk_start")


@query("chunk_sentences_overlap", sql("prose", PROSE + """,
 c as (select recording_id, n, floor(length(text)/case when coalesce(language,'')='' or regexp_extract(lower(trim(language)),'^([^_-]*)',1)='it' then 2.8 else 4.4 end)::BIGINT+8 as cost from sents),
 u as (select recording_id, list_prepend(0::BIGINT, list(upto order by n)) as upto, count(*) as size from (select recording_id, n, (sum(cost) over (partition by recording_id order by n))::BIGINT as upto from c) group by all),
 step as (with recursive r(recording_id, low, fresh, high) as (
   select recording_id, 0::BIGINT, 0::BIGINT, greatest(1, len(list_filter(upto, lambda x: x<=600))-1)::BIGINT from u
   union all
   select recording_id, back, high, greatest(high+1, len(list_filter(upto, lambda x: x<=upto[back+1]+600))-1)::BIGINT from (
    select r.recording_id, upto, high, greatest(low+1, len(list_filter(upto, lambda x: x<upto[high+1]-90)))::BIGINT as back from r join u using (recording_id) where high<size)) select * from r)
 select recording_id, unnest(range(low, high)) as sent_no, fresh as chunk_start, unnest(range(low, high))<fresh as carried from step"""))
def _(spark, sf):
    return no.chunk_sentences(sentences(spark, sf), 600, 0.15, "language")


@query("cut_to_fit")
def _(spark, sf):
    return no.cut_to_fit(sentences(spark, sf), ranked(spark, sf), 300, 4, 0.1, "language").select("recording_id", "sent_no")


@query("fold_tree", sql("segments", """,
 c as (select recording_id, max(seg_no)+1 as n from segments group by all),
 w as (select *, greatest(6, ceil(sqrt(n::DOUBLE)-1e-9))::BIGINT as w from c),
 l1 as (select s.recording_id, 1 as level, seg_no//w as group_no, seg_no as member, n, w from segments s join w using (recording_id)),
 l2 as (select distinct recording_id, 2 as level, group_no//w as group_no, group_no as member from l1 where n>w)
 select recording_id, level, group_no, member from l1 union all select * from l2"""))
def _(spark, sf):
    return no.fold_tree(fx.segments(spark, sf).select("recording_id", F.col("seg_no").alias("idx")))


def _passes(spark, sf):
    n = notes(spark, sf)
    per = n.groupBy("recording_id", "chunk_idx").agg(F.count("*").alias("notes"), F.count("ts_start_ms").alias("placed"),
                                                     F.sort_array(F.collect_list("ts_start_ms")).alias("starts"))
    odd = no.unknown_headings(fx.answers(spark, sf), lx.kinds(spark), "it").groupBy("recording_id", "chunk_idx").agg(F.collect_set("heading").alias("unknown_headings"))
    a = fx.answers(spark, sf)
    return (a.join(per, ["recording_id", "chunk_idx"], "left").join(odd, ["recording_id", "chunk_idx"], "left").select(
        "recording_id", "chunk_idx", F.lit(1000).alias("in_tokens"), (F.length("answer") % 200).alias("out_tokens"), F.lit(150).alias("budget"),
        F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("placed", F.lit(0)).alias("placed"), F.lit(0).alias("copied"),
        F.when(F.col("chunk_idx") % 5 == 3, "ECHOED").otherwise("OK").alias("status"), "span_start_ms", "span_end_ms",
        F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts"), F.coalesce("unknown_headings", F.array().cast("array<string>")).alias("unknown_headings")))


@query("pass_counts", sql("answers", NOTES_SQL + """,
 per as (select recording_id, chunk_idx, count(*) as notes, min(ts_start_ms) as lo, max(ts_start_ms) as hi from notes group by all),
 p as (select a.recording_id, a.chunk_idx, length(answer)%200 as out_tokens, coalesce(notes,0) as notes, a.chunk_idx%5=3 as echoed,
   case when span_end_ms>span_start_ms and notes is not null then least(1.0, (hi-lo)/(span_end_ms-span_start_ms)) end as covered, hd.h
   from answers a left join per using (recording_id, chunk_idx) left join hd using (recording_id, chunk_idx)),
 q as (select recording_id, count(*) as chunks, count_if(notes=0) as empty_chunks, count_if(echoed) as echoed_chunks,
   count_if(not echoed and out_tokens>=147) as chunks_exhausted, sum(notes)::BIGINT as notes, sum(notes)::BIGINT as notes_placed, 0 as notes_copied,
   0 as unplaced_chunks, 150 as map_budget, round(min(covered),6) as least_covered_chunk,
   case when count_if(h='Weather')>0 then ['Weather'] else [] end as unknown_headings,
   count(*) as folds, count_if(chunk_idx%4=1) as folds_collapsed, (2*count_if(chunk_idx%4=1))::BIGINT as partials_lost, 0 as folds_exhausted from p group by recording_id)
 select * from q"""))
def _(spark, sf):
    p = _passes(spark, sf)
    folds = p.select("recording_id", "out_tokens", "budget", F.when(F.col("chunk_idx") % 4 == 1, "COLLAPSED").otherwise("OK").alias("status"), F.lit(2).alias("lost"))
    return me.pass_counts(p, folds)


@query("parse_sections")
def _(spark, sf):
    """The answers as whole pages: three of their headings are a page's."""
    return no.parse_sections(fx.answers(spark, sf).select("recording_id", "chunk_idx", "answer"), "it")


def shout():
    """A model for tests: it answers with the first line, in capitals."""
    return lambda text: text.split("\n", 1)[0].upper()


@query("map_text", sql("answers", "select recording_id, chunk_idx, upper(split_part(answer, chr(10), 1)) as answer from answers"))
def _(spark, sf):
    from colloquy.queries.catalogue_q import _chunks
    c = _chunks(spark, sf)
    known = c.where("recording_id % 2 = 0").select(
        ca.pass_key(*[F.col(x) for x in ca.PASS_KEY]).alias("pass_key"), F.upper(F.split_part("text", F.lit("\n"), F.lit(1))).alias("answer"), F.lit(1).alias("used_at"))
    return co.ask_cached(c, known, shout)[0].select("recording_id", "chunk_idx", "answer")
