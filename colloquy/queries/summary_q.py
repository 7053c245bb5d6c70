"""Terms, ranking, summaries and their measures over the prose fixture."""

from pyspark.sql import functions as F

from colloquy import fixtures as fx
from colloquy.registry import ORACLES, query
from colloquy.fixtures import sql, sql_fold
from colloquy.functions import lexicons as lx
from colloquy.operators import layout as lo
from colloquy.operators import metrics as me
from colloquy.operators import summarise as su
from colloquy.operators import terms as tm
from colloquy.queries.layout_q import _CLEAN
from colloquy.queries.sentences_sql import SENTENCES

LANG = "language"


@fx.written
def sentences(spark, sf):
    return tm.split_sentences(fx.prose(spark, sf))


@fx.written
def weighted(spark, sf):
    return tm.weights(sentences(spark, sf), LANG)


@fx.written
def ranked(spark, sf):
    return su.textrank(sentences(spark, sf), weighted(spark, sf))


def _quoted(words):
    return ",".join("'" + w.replace("'", "''") + "'" for w in words)


def terms_sql(view, n="n"):
    """CTEs ending in ``terms(recording_id, n, term)`` over ``view(recording_id, n, text)``."""
    return f""" t0 as (select recording_id, {n} as n, unnest(regexp_extract_all(lower(text), '\\p{{L}}+(?:''\\p{{L}}+)?|\\p{{Nd}}+')) as w from {view}),
 t1 as (select recording_id, n, case when split_part(w,'''',2)<>'' and {sql_fold("split_part(w,'''',1)")} in ({_quoted(lx.ELIDED)})
    then split_part(w,'''',2) else w end as term from t0),
 terms as (select * from t1 where length(term)>=3 and {sql_fold('term')} not in ({_quoted(lx.STOP_WORDS['en'])}))"""


def weights_sql(view, n="n"):
    return terms_sql(view, n) + f""",
 tf as (select recording_id, n, term, count(*) as tf from terms group by all),
 nn as (select recording_id, count(*) as nn from {view} group by all),
 dfs as (select recording_id, term, count(*) as df from tf group by all),
 raw as (select tf.*, df, tf*(ln((1.0+nn)/(1.0+df))+1.0) as r from tf join dfs using (recording_id, term) join nn using (recording_id)),
 weights as (select recording_id, n, term, tf, df, r/sqrt(sum(r*r) over (partition by recording_id, n)) as w from raw)"""


PROSE = ",\n " + SENTENCES
WEIGHTS = PROSE + ",\n" + weights_sql("sents")


@query("split_sentences", sql("prose", PROSE + " select recording_id, n as sent_no, text from sents"))
def _(spark, sf):
    return tm.split_sentences(fx.prose(spark, sf)).select("recording_id", "sent_no", "text")


@query("paragraphs_from_prose", sql("prose", PROSE + """
 select recording_id, n//5 as para_no, string_agg(text,' ' order by n) as text from sents group by recording_id, n//5"""))
def _(spark, sf):
    return lo.paragraphs_from_prose(sentences(spark, sf))


@query("paragraphs_of_text", sql("prose", f""",
 flat as (select recording_id, string_split(regexp_replace({_CLEAN.format("coalesce(text,'')")},'([.!?…])\\s+','\\1'||chr(31),'g'),chr(31)) as s from prose),
 cut as (select recording_id, unnest(s) as t, generate_subscripts(s,1)-1 as n from flat)
 select recording_id, (n//5)::BIGINT as para_no, trim(string_agg(t,' ' order by n)) as text from cut group by recording_id, n//5 having trim(string_agg(t,' ' order by n))<>''"""))
def _(spark, sf):
    return lo.paragraphs_of_text(fx.prose(spark, sf))


@query("content_terms", sql("prose", PROSE + ",\n" + terms_sql("sents") + """
 select recording_id, term, count(*) as uses from terms group by all"""))
def _(spark, sf):
    return tm.content_terms(sentences(spark, sf), LANG).groupBy("recording_id", "term").agg(F.count("*").alias("uses"))


@query("term_weights", sql("prose", WEIGHTS + """
 select recording_id, n as sent_no, count(*) as words, max(df) as df_max, round(sum(w), 6) as total from weights group by all"""))
def _(spark, sf):
    return weighted(spark, sf).groupBy("recording_id", "sent_no").agg(
        F.count("*").alias("words"), F.max("df").alias("df_max"), F.round(F.sum("w"), 6).alias("total"))


@query("keywords", sql("prose", WEIGHTS + """
 , k as (select recording_id, term, round(sum(w),6) as weight from weights group by all)
 select recording_id, row_number() over (partition by recording_id order by weight desc, term) as rank, term, weight from k
 where weight>0 qualify rank<=10"""))
def _(spark, sf):
    return tm.keywords(weighted(spark, sf))


@query("sentence_similarity", sql("prose", WEIGHTS + """
 , v as (select recording_id, n, string_agg(term||chr(31)||tf, chr(30) order by term) as same from weights group by all),
 f as (select *, min(n) over (partition by recording_id, same) as first_n from v),
 h as (select w.* from weights w join f using (recording_id, n) where f.n=f.first_n)
 select recording_id, first_n as a, n as b, 1.0::DOUBLE as sim from f where n<>first_n
 union all
 select x.recording_id, x.n, y.n, round(sum(x.w*y.w),6) from h x join h y on x.recording_id=y.recording_id and x.term=y.term and x.n<y.n
 group by all having round(sum(x.w*y.w),9)>=0.62"""))
def _(spark, sf):
    s = sentences(spark, sf)
    p = tm.similar_pairs(tm.weights(s, LANG), su.REDUNDANCY, large=tm.long_recordings(s))
    return p.select("recording_id", F.col("a.sent_no").alias("a"), F.col("b.sent_no").alias("b"), F.round("sim", 6).alias("sim"))


def _walk_sql(rounds=su.ROUNDS):
    """CTEs ending in ``ranked(recording_id, n, score)``: the walk's rounds one after the other; a recording at rest stays as it is."""
    steps = [""",
 lone as (select recording_id, term, count(*) as c, sum(w) as t from weights group by all),
 s0 as materialized (select recording_id, n, size, 1.0/size as score, coalesce(total,0) as total, size>1 as going from (select recording_id, n, count(*) over (partition by recording_id) as size from sents)
   left join (select recording_id, n, sum(case when c=1 then 0 else w*(t-w) end) as total from weights join lone using (recording_id, term) group by all) using (recording_id, n))"""]
    for i in range(rounds):
        steps.append(f""",
 z{i} as materialized (select recording_id, n, term, w, w*(case when total<=0 then 0 else score/total end) as wz from weights join s{i} using (recording_id, n) where going),
 o{i} as (select recording_id, n, sum(case when c=1 then 0 else w*(t-wz) end) as o from z{i} join (select recording_id, term, sum(wz) as t, count(*) as c from z{i} group by all) using (recording_id, term) group by all),
 m{i} as (select recording_id, sum(case when total<=0 then score else 0 end) as mass from s{i} where going group by all),
 n{i} as (select s{i}.*, 0.15/size+0.85*(coalesce(o,0)+mass/size) as fresh from s{i} left join o{i} using (recording_id, n) left join m{i} using (recording_id)),
 s{i + 1} as materialized (select recording_id, n, size, case when going then fresh else score end as score, total,
   going and max(abs(fresh-score)>1e-9+1e-5*abs(score)) over (partition by recording_id) as going from n{i})""")
    return "".join(steps) + f""",
 ranked as (select recording_id, n, round(score, 10) as score from s{rounds})"""


_WALK = "with recursive " + sql("prose", WEIGHTS + _walk_sql())[len("with "):].lstrip()
_ORDERED = """,
 placed as (select recording_id, n, row_number() over (partition by recording_id order by score desc, n desc) as at_, count(*) over (partition by recording_id) as size from ranked)"""


@query("textrank", _WALK + " select recording_id, n as sent_no, round(score, 6) as score from ranked")
def _(spark, sf):
    return su.textrank(sentences(spark, sf), weighted(spark, sf)).withColumn("score", F.round("score", 6))


_DIVERSE = _WALK + _ORDERED + """,
 near as (select x.recording_id, x.n as a, list(y.n) as rivals from (
    select x.recording_id, x.n, y.n as m from weights x join weights y on x.recording_id=y.recording_id and x.term=y.term and x.n<>y.n group by all having sum(x.w*y.w)>=0.62) x
    join placed y on x.recording_id=y.recording_id and x.m=y.n group by all),
 room as (select distinct recording_id, case when size<=5 then size else greatest(5, least(15, round_even(size*0.10, 0))) end::BIGINT as k from placed),
 pick(recording_id, at_, chosen) as (
  select recording_id, 0::BIGINT, []::BIGINT[] from room
  union all
  select pick.recording_id, placed.at_, case when list_has_any(chosen, coalesce(rivals, []::BIGINT[])) then chosen else list_append(chosen, placed.n::BIGINT) end
  from pick join room using (recording_id) join placed on placed.recording_id=pick.recording_id and placed.at_=pick.at_+1
   left join near on near.recording_id=placed.recording_id and near.a=placed.n where len(chosen)<k),
 diverse as (select recording_id, unnest(arg_max(chosen, at_)) as sent_no from pick group by recording_id)"""


@query("select_diverse", _DIVERSE + " select recording_id, sent_no from diverse")
def _(spark, sf):
    k = ranked(spark, sf).groupBy("recording_id").agg(su.how_many(F.count("*")).alias("k"))
    return su.select_diverse(ranked(spark, sf), weighted(spark, sf), k).select("recording_id", "sent_no")


@query("reduce_to_budget", _WALK + _ORDERED + """,
 costed as (select p.*, floor(length(text)/case when coalesce(language,'')='' or regexp_extract(lower(trim(language)),'^([^_-]*)',1)='it' then 2.8 else 4.4 end)::BIGINT as cost
   from placed p join sents using (recording_id, n)),
 all_ as (select recording_id, sum(cost) as total from costed group by all),
 take(recording_id, at_, remaining, n, kept) as (
  select recording_id, 0::BIGINT, 400::BIGINT, -1::BIGINT, false from all_ where total>400
  union all
  select take.recording_id, c.at_, take.remaining-case when c.cost<=take.remaining and take.remaining>0 then c.cost else 0 end, c.n::BIGINT, c.cost<=take.remaining and take.remaining>0
  from take join costed c on c.recording_id=take.recording_id and c.at_=take.at_+1)
 select recording_id, n as sent_no from take where kept union all select recording_id, n from costed join all_ using (recording_id) where total<=400""")
def _(spark, sf):
    budget = fx.prose(spark, sf).select("recording_id", F.lit(400).cast("long").alias("budget"))
    return su.reduce_to_budget(sentences(spark, sf), ranked(spark, sf), budget, LANG).select("recording_id", "sent_no")


_TAKE = _ORDERED + """,
 costed as (select p.*, text, floor(length(text)/case when coalesce(language,'')='' or regexp_extract(lower(trim(language)),'^([^_-]*)',1)='it' then 2.8 else 4.4 end)::BIGINT as cost
   from placed p join sents using (recording_id, n)),
 all_ as (select recording_id, sum(cost) as total from costed group by all),
 take(recording_id, at_, remaining, n, kept) as (
  select recording_id, 0::BIGINT, 200::BIGINT, -1::BIGINT, false from all_ where total>200
  union all
  select take.recording_id, c.at_, take.remaining-case when c.cost<=take.remaining and take.remaining>0 then c.cost else 0 end, c.n::BIGINT, c.cost<=take.remaining and take.remaining>0
  from take join costed c on c.recording_id=take.recording_id and c.at_=take.at_+1)"""


@query("evidence_extract", _WALK + _TAKE + """
 select recording_id, n as sent_no, text as line from costed where (recording_id, n) in (
  select (recording_id, n) from take where kept union all select (recording_id, n) from costed join all_ using (recording_id) where total<=200)""")
def _(spark, sf):
    """The best 200 tokens of every recording, laid out as a prompt."""
    budget = fx.prose(spark, sf).select("recording_id", F.lit(200).cast("long").alias("budget"))
    kept = su.reduce_to_budget(sentences(spark, sf), ranked(spark, sf), budget, LANG)
    none = F.lit(None)
    return lo.prompt_text(kept.withColumns({"start_ms": none.cast("long"), "speaker": none.cast("string")}), "sent_no")


@query("extractive_summary", _DIVERSE + """,
 ex as (select d.recording_id, sent_no, row_number() over (partition by d.recording_id order by score desc, sent_no) as r, count(*) over (partition by d.recording_id) as c
   from diverse d join ranked on ranked.recording_id=d.recording_id and ranked.n=sent_no),
 kw as (select recording_id, list(term order by rank) as keywords from (
   select recording_id, term, weight, row_number() over (partition by recording_id order by weight desc, term) as rank from (select recording_id, term, round(sum(w),6) as weight from weights group by all) where weight>0 qualify rank<=10) group by all)
 select recording_id, string_agg(text, ' ' order by sent_no) filter (where r<=greatest(1,least(3,c//3))) as abstract, count(*) filter (where r>greatest(1,least(3,c//3)))::INT as points, any_value(keywords) as keywords
 from ex join sents on sents.recording_id=ex.recording_id and sents.n=sent_no left join kw on kw.recording_id=ex.recording_id group by ex.recording_id""".replace("select recording_id, string_agg", "select ex.recording_id, string_agg"))
def _(spark, sf):
    s = su.extractive_summary(sentences(spark, sf), LANG)
    return s.select("recording_id", "abstract", F.size("points").alias("points"), "keywords")


@query("suggest_titles")
def _(spark, sf):
    return su.suggest_titles(sentences(spark, sf))


@query("summary_page", sql("segments", """
 , p as (select recording_id, '- `['||(start_ms//60000)||':'||lpad(((start_ms//1000)%60)::VARCHAR,2,'0')||']` **'||speaker||'** '||text as b, seg_no from segments),
 b as (select recording_id, string_agg(b, chr(10) order by seg_no) as body from p group by all),
 m as (select recording_id, max(end_ms) as d, arg_min(text, seg_no) as a from segments group by all)
 select m.recording_id, case when recording_id%2=0 then '# Riassunto: Rec '||recording_id else '# Summary: Rec '||recording_id end||chr(10)||chr(10)||
  case when recording_id%2=0 then '_extractive, 2026-01-01 10:00 — da una registrazione di '||round_even(d/60000.0,0)::INT||' minuti_'
       else '_extractive, 2026-01-01 10:00 — from a '||round_even(d/60000.0,0)::INT||'-minute recording_' end||chr(10)||chr(10)||
  case when recording_id%2=0 then '## In breve' else '## In brief' end||chr(10)||chr(10)||a||chr(10)||
  coalesce(chr(10)||case when recording_id%2=0 then '## Punti chiave' else '## Key points' end||chr(10)||chr(10)||body||chr(10), '')||chr(10)||
  case when recording_id%2=0 then '## Termini ricorrenti' else '## Recurring terms' end||chr(10)||chr(10)||'one, two'||chr(10) as page
 from m left join b using (recording_id)"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    pts = s.groupBy("recording_id").agg(F.sort_array(F.collect_list(
        F.struct("seg_no", "start_ms", "speaker", "text"))).alias("points"))
    m = s.groupBy("recording_id").agg(F.max("end_ms").alias("duration_ms"), F.min_by("text", "seg_no").alias("abstract"))
    given = m.join(pts, "recording_id", "left").select(
        "recording_id", "duration_ms", "abstract", "points", F.concat(F.lit("Rec "), "recording_id").alias("title"),
        F.lit("extractive").alias("engine"), F.lit("2026-01-01 10:00").alias("written"),
        F.when(F.col("recording_id") % 2 == 0, "it").otherwise("en").alias("language"),
        F.array(F.lit("one"), F.lit("two")).alias("keywords"))
    return su.page(given)


@query("coverage", sql("segments answers", """
 , b as (select recording_id, start_ms from segments where speaker='assistant'),
 d as (select recording_id, max(end_ms) as dur from segments group by all),
 s as (select b.recording_id, count(distinct start_ms//60000) as seen from b join d using (recording_id) where start_ms<dur group by all)
 select d.recording_id, round(least(1.0, coalesce(seen,0)/greatest(1, ceil(dur/60000.0))),6) as coverage,
   round(least(1.0, coalesce(seen,0)/greatest(1, ceil(dur/60000.0))),6)<0.8 as low from d left join s using (recording_id)"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    lengths = s.groupBy("recording_id").agg(F.max("end_ms").alias("duration_ms"))
    return me.coverage(s.where("speaker = 'assistant'").select("recording_id", "start_ms"), lengths)


@query("copy_rate", sql("prose", PROSE + f""",
 pts as (select recording_id, text from sents union all
   select d.recording_id, b.text from prose d join benchmark b on b.item_id=d.recording_id%40),
 pw as (select recording_id, string_split(trim(regexp_replace({sql_fold('text')},'\\s+',' ','g')),' ') as w from pts),
 ps as (select recording_id, unnest(list_transform(range(1, len(w)-6), lambda i: array_to_string(list_slice(w,i,i+7),' '))) as s from pw where len(w)>=8),
 tw as (select recording_id, string_split(trim(regexp_replace({sql_fold('text')},'\\s+',' ','g')),' ') as w from prose),
 ts as (select distinct recording_id, unnest(list_transform(range(1, len(w)-6), lambda i: array_to_string(list_slice(w,i,i+7),' '))) as s from tw where len(w)>=8),
 c as (select ps.recording_id, count(*) as windows, count(ts.s) as copied from ps left join ts on ps.recording_id=ts.recording_id and ps.s=ts.s group by all)
 select tw.recording_id, windows, copied, case when len(w)>=8 and windows>0 then round(copied/windows,6) end as copy_rate,
   case when len(w)>=8 and windows>0 then round(copied/windows,6)>0.3 end as high from tw left join c using (recording_id)"""))
def _(spark, sf):
    p = fx.prose(spark, sf)
    passages = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("_i"), F.col("text").alias("_t"))
    told = p.select("recording_id", (F.col("recording_id") % 40).alias("_i")).join(passages, "_i").select("recording_id", F.col("_t").alias("text"))
    points = sentences(spark, sf).select("recording_id", "text").unionByName(told)
    return me.copy_rate(points, p)


_RW = "regexp_extract_all({},'\\p{{L}}+|\\p{{Nd}}+')"


def _pairs(spark, sf):
    h = fx.heard(spark, sf)
    def text(c):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", c))), lambda x: x[c]), " ").alias("text")
    key = F.concat_ws(":", "recording_id", "seg_no").alias("id")
    return (h.groupBy("recording_id", "seg_no").agg(text("heard")).select(key, "text"),
            h.groupBy("recording_id", "seg_no").agg(text("given")).select(key, "text"))


def _rouge_sql(k):
    g = lambda c: f"unnest(list_transform(range(1, len({c})+{2-k}), lambda i: array_to_string(list_slice({c},i,i+{k-1}),' ')))"
    return f""",
 w as (select recording_id||':'||seg_no as id, {_RW.format(sql_fold("string_agg(heard,' ' order by word_no)"))} as h,
   {_RW.format(sql_fold("string_agg(given,' ' order by word_no)"))} as r from heard group by recording_id, seg_no),
 hgm as (select id, gram, count(*) as n from (select id, {g('h')} as gram from w where len(h)>={k}) group by all),
 rgm as (select id, gram, count(*) as n from (select id, {g('r')} as gram from w where len(r)>={k}) group by all),
 b as (select id, sum(least(hg.n, rg.n)) as both_n from hgm hg join rgm rg using (id, gram) group by id),
 x as (select id, greatest(len(h)-{k-1},0) as hn, greatest(len(r)-{k-1},0) as rn, coalesce(both_n,0) as o from w left join b using (id))
 select id, round(case when o>0 then 2*(o/hn)*(o/rn)/((o/hn)+(o/rn)) else 0.0 end,6) as rouge_{k} from x"""


@query("rouge_1", sql("heard", _rouge_sql(1)))
def _(spark, sf):
    return me.rouge_n(*_pairs(spark, sf), 1)


@query("rouge_2", sql("heard", _rouge_sql(2)))
def _(spark, sf):
    return me.rouge_n(*_pairs(spark, sf), 2)


@query("rouge_l", sql("heard", f""",
 w as (select recording_id||':'||seg_no as id, {_RW.format(sql_fold("string_agg(heard,' ' order by word_no)"))} as h,
   {_RW.format(sql_fold("string_agg(given,' ' order by word_no)"))} as r from heard group by recording_id, seg_no),
 step as (with recursive l(id, i, v) as (
   select id, 0, list_transform(r, lambda x: 0) from w
   union all
   select l.id, i+1, list_transform(range(1, len(r)+1), lambda j: list_max(list_transform(range(1, j+1), lambda k: case when r[k]=h[i+1] then coalesce(case when k>1 then v[k-1] end, 0)+1 else v[k] end)))
   from l join w using (id) where i<len(h)) select id, i, coalesce(v[-1], 0) as lcs from l)
 select w.id, round(case when lcs>0 then 2*(lcs/len(h))*(lcs/len(r))/((lcs/len(h))+(lcs/len(r))) else 0.0 end,6) as rouge_l from w join step on step.id=w.id and step.i=len(h)"""))
def _(spark, sf):
    return me.rouge_l(*_pairs(spark, sf))


@query("screening_report", sql("prose", """
 , a as (select case when recording_id%2=0 then 'a' else 'b' end as model, case when recording_id%5=0 then '' when recording_id%5=1 then text
    else substr(text, 30, 50) end as text, text as source, recording_id%9+0.5 as seconds from prose),
 n as (select *, trim(regexp_replace(text,'\\s+',' ','g')) as t, substr(trim(regexp_replace(source,'\\s+',' ','g')),1,60) as s from a)
 select model, count(*) as items, 0.5::DOUBLE as rouge_1, 0.25::DOUBLE as rouge_2, count_if(starts_with(t,s)) as copied, count_if(t='') as empty,
  round(avg(seconds),6) as seconds from n group by model"""))
def _(spark, sf):
    r = F.col("recording_id")
    a = fx.prose(spark, sf).select(
        F.when(r % 2 == 0, "a").otherwise("b").alias("model"), r.alias("id"),
        F.when(r % 5 == 0, "").when(r % 5 == 1, F.col("text")).otherwise(F.substring("text", 30, 50)).alias("text"),
        F.col("text").alias("source"), (r % 9 + 0.5).alias("seconds"), F.lit(0.5).alias("rouge_1"), F.lit(0.25).alias("rouge_2"))
    return me.screening_report(a)


@query("screening_of_answers", f"""with r1 as ({ORACLES['rouge_1']}), r2 as ({ORACLES['rouge_2']}),
 t as (select id, split_part(id,':',1)::BIGINT as recording_id, rouge_1, rouge_2 from r1 join r2 using (id)),
 h as ({sql("heard", " select recording_id||':'||seg_no as id, string_agg(heard,' ' order by word_no) as text, string_agg(given,' ' order by word_no) as source from heard group by recording_id, seg_no")})
 select case when recording_id%2=0 then 'a' else 'b' end as model, count(*) as items, round(avg(rouge_1),6) as rouge_1, round(avg(rouge_2),6) as rouge_2,
  count_if(starts_with(trim(regexp_replace(text,'\\s+',' ','g')), substr(trim(regexp_replace(source,'\\s+',' ','g')),1,60))) as copied, count_if(trim(text)='') as empty, round(avg(recording_id%9+0.5),6) as seconds
 from t join h using (id) group by all""")
def _(spark, sf):
    """Of answers with their measured overlaps: what was heard against what was given."""
    heard, given = _pairs(spark, sf)
    r = F.split_part("id", F.lit(":"), F.lit(1)).cast("long")
    a = heard.join(given.withColumnRenamed("text", "source"), "id").join(me.rouge_n(heard, given, 1), "id").join(me.rouge_n(heard, given, 2), "id")
    return me.screening_report(a.withColumns({"model": F.when(r % 2 == 0, "a").otherwise("b"), "seconds": r % 9 + 0.5}))


@query("estimate_tokens", sql("prose", PROSE + """
 select recording_id, sum(floor(length(text)/4.4::DOUBLE))::BIGINT as tokens, sum(length(text))::BIGINT as chars from sents group by all"""))
def _(spark, sf):
    return me.token_totals(sentences(spark, sf), LANG)


@query("reduction_share", sql("prose", PROSE + """
 , k as (select recording_id, sum(floor(length(text)/4.4::DOUBLE))::BIGINT as kept from sents where length(text)>=80 group by all),
 w as (select recording_id, sum(floor(length(text)/4.4::DOUBLE))::BIGINT as tokens from sents group by all)
 select recording_id, tokens, coalesce(kept,0) as kept_tokens, case when tokens>0 then round_even(100.0*coalesce(kept,0)/tokens,0)::BIGINT end as kept_share from w left join k using (recording_id)"""))
def _(spark, sf):
    s = sentences(spark, sf)
    return me.reduction_share(s.where(F.length("text") >= 80), s, LANG)
