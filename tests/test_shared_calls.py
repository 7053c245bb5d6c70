"""Recordings share a call, and words are counted where their sentences arrive."""

from pyspark.sql import functions as F

from colloquy.operators import metrics as me
from colloquy.operators import summarise as su
from colloquy.operators import terms as tm


def _sentences(spark):
    words = ["river", "stone", "bridge", "garden", "winter", "market"]
    rows = [(r, n, " ".join(words[(r + n * k) % 6] for k in range(1, 4 + (r + n) % 3)), "en") for r in range(40) for n in range(8)]
    return spark.createDataFrame(rows, "recording_id long, sent_no long, text string, language string").cache()


def _plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_words_are_not_shuffled(spark):
    s = _sentences(spark)
    small, large = tm.weights(s, "language"), tm.weights(s, "language", task_chars=150)
    assert _plain(small) == _plain(large) and small.count() > 0
    # The sentences and their numbers travel; words do not.
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)


def test_recordings_share_a_call(spark, monkeypatch):
    s = _sentences(spark)
    w = tm.weights(s, "language").cache()
    one = su.textrank(s, w)
    assert "FlatMapGroupsInArrow [_bucket" in one._jdf.queryExecution().optimizedPlan().toString()
    budget = s.select("recording_id").distinct().withColumn("budget", F.lit(12).cast("long"))
    want = _plain(one), _plain(su.reduce_to_budget(s, one, budget, "language").select("recording_id", "sent_no"))
    monkeypatch.setattr(su, "BUCKET_ROWS", 10)
    many = su.textrank(s, w)
    assert (_plain(many), _plain(su.reduce_to_budget(s, many, budget, "language").select("recording_id", "sent_no"))) == want
    assert 0 < len(want[1]) < 320


def test_runs_of_words_are_counted_where_their_texts_arrive(spark):
    rows = [(r, " ".join(f"w{(r * n) % 7}" for n in range(20 + r))) for r in range(1, 12)]
    points = spark.createDataFrame(rows + [(5, "one two three four five six seven eight"), (3, None), (99, rows[0][1])], "recording_id long, text string").cache()
    texts = spark.createDataFrame([(r, "x y " + t if r % 3 else t[:20]) for r, t in rows] + [(12, "short"), (13, None)], "recording_id long, text string").cache()
    whole = me.copy_rate(points, texts)
    want = sorted(map(tuple, whole.collect()), key=str)
    assert len(want) == 13 and any(w[2] for w in want)
    assert sorted(map(tuple, me.copy_rate(points, texts, task_chars=60).collect()), key=str) == want
    assert sorted(map(tuple, me.copy_rate(points, texts, task_chars=0).collect()), key=str) == want
    assert "shingle#" not in "".join(x for x in whole._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)


def test_sentences_are_compared_where_their_words_are(spark, monkeypatch):
    s = _sentences(spark).unionByName(_sentences(spark).where("recording_id < 9").withColumn("sent_no", F.col("sent_no") + 8)).cache()
    w = tm.weights(s, "language")
    none, all_ = tm.long_recordings(s), tm.long_recordings(s, 0)
    pairs = tm.similar_pairs(w, 0.4, large=none)
    want = _plain(tm.similar_pairs(w, 0.4, large=all_))
    assert len(want) > 100 and len({r[0] for r in want}) == 40
    assert _plain(pairs) == want
    assert _plain(tm.similar_pairs(w, 0.4, large=all_.where("recording_id % 3 = 0"))) == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "w#" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x) and "term#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
    monkeypatch.setattr(tm, "CELLS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _plain(tm.similar_pairs(w, 0.4, large=none)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_summaries_are_made_where_the_words_are(spark):
    some = _sentences(spark)
    empty = spark.createDataFrame([(41, 0, "a b", "en"), (41, 1, "", "en"), (42, 0, "river", "en")], some.schema)
    s = some.unionByName(some.withColumn("sent_no", F.col("sent_no") + 8).where("recording_id % 4 = 0")).unionByName(empty).cache()
    want = sorted(map(str, su.extractive_summary(s, "language", task_chars=0).collect()))
    assert len(want) == 42
    assert sorted(map(str, su.extractive_summary(s, "language").collect())) == want
    assert sorted(map(str, su.extractive_summary(s, "language", task_chars=200).collect())) == want
    _, terms = su._chosen_and_terms(some, "language", "medium", 2, None)
    assert terms.count() < some.select("recording_id").distinct().count() * 6
