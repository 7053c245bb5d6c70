"""Ranking, choosing and grouping against the plain arithmetic on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import sections as se
from colloquy.operators import summarise as su
from colloquy.operators import terms as tm

POOL = ["dashboard", "budget", "contract", "server", "migration", "customer", "ticket", "release", "design", "layout", "invoice", "training"]


@pytest.fixture(scope="module")
def sentences(spark):
    rnd = random.Random(8)
    rows = []
    for r in range(4):
        for i in range(60):
            words = rnd.choices(POOL, k=rnd.randint(1, 6)) if i % 17 else ["of", "the"]
            rows.append((r, i, " ".join(words)))
    rows += [(9, 0, "only sentence here")]
    return spark.createDataFrame(rows, "recording_id long, sent_no long, text string").cache()


@pytest.fixture(scope="module")
def weighted(sentences):
    return tm.weights(sentences).cache()


def matrix(weighted, r, n):
    rows = weighted.where(f"recording_id = {r}").collect()
    names = sorted({x["term"] for x in rows})
    m = np.zeros((n, max(1, len(names))))
    for x in rows:
        m[x["sent_no"], names.index(x["term"])] = x["w"]
    return m


def plain_rank(m):
    n = len(m)
    s = m @ m.T
    np.fill_diagonal(s, 0)
    total = s.sum(axis=1)
    step = np.where(total[:, None] > 1e-12, s / np.where(total > 1e-12, total, 1)[:, None], 1 / n)
    score = np.full(n, 1 / n)
    for _ in range(40):
        new = 0.15 / n + 0.85 * step.T @ score
        done, score = np.allclose(new, score, atol=1e-9), new
        if done:
            break
    return score


def test_textrank_is_the_walk_in_a_task_and_over_the_cluster(sentences, weighted):
    here = {(x["recording_id"], x["sent_no"]): x["score"] for x in su.textrank(sentences, weighted).collect()}
    spread = {(x["recording_id"], x["sent_no"]): x["score"] for x in su.textrank(sentences, weighted, task_words=20).collect()}
    assert here.keys() == spread.keys() and here[(9, 0)] == 1.0
    for r in range(4):
        want = plain_rank(matrix(weighted, r, 60))
        assert np.allclose([here[(r, i)] for i in range(60)], want, rtol=1e-5)
        assert np.allclose([spread[(r, i)] for i in range(60)], want, rtol=1e-5)


def test_select_diverse_is_the_greedy_choice(sentences, weighted, monkeypatch):
    scores = su.textrank(sentences, weighted).cache()
    k = scores.groupBy("recording_id").agg(F.lit(9).alias("k"))

    def chosen():
        out = su.select_diverse(scores, weighted, k).collect()
        return {r: sorted(x["sent_no"] for x in out if x["recording_id"] == r) for r in range(4)}

    whole = chosen()
    monkeypatch.setattr(su, "BATCH", 7)          # several rounds
    assert chosen() == whole
    for r in range(4):
        m, score = matrix(weighted, r, 60), {x["sent_no"]: x["score"] for x in scores.where(f"recording_id = {r}").collect()}
        want = []
        for i in sorted(score, key=lambda i: (score[i], i), reverse=True):
            if len(want) < 9 and (not want or max(m[want] @ m[i]) < 0.62):
                want.append(i)
        assert whole[r] == sorted(want)


def test_reduce_takes_what_fits_best_first(sentences, weighted, monkeypatch):
    scores = su.textrank(sentences, weighted).cache()
    budget = scores.select("recording_id").distinct().withColumn("budget", F.lit(150).cast("long"))

    def kept():
        return {(x["recording_id"], x["sent_no"]) for x in su.reduce_to_budget(sentences, scores, budget).collect()}

    whole = kept()
    monkeypatch.setattr(su, "BATCH", 5)
    assert kept() == whole and (9, 0) in whole
    for r in range(4):
        text = {x["sent_no"]: x["text"] for x in sentences.where(f"recording_id = {r}").collect()}
        score = {x["sent_no"]: x["score"] for x in scores.where(f"recording_id = {r}").collect()}
        left, want = 150, set()
        for i in sorted(score, key=lambda i: (score[i], i), reverse=True):
            cost = int(len(text[i]) / 2.8)
            if left > 0 and cost <= left:
                want.add((r, i))
                left -= cost
        assert {x for x in whole if x[0] == r} == want


def test_similar_pairs_miss_none(weighted):
    got = {(x["recording_id"], x["a"]["sent_no"], x["b"]["sent_no"]) for x in tm.similar_pairs(weighted, 0.62).collect()}
    for r in range(4):
        m = matrix(weighted, r, 60)
        rows = {i: tuple(np.round(m[i], 9)) for i in range(60) if m[i].any()}
        first = {}
        for i, v in rows.items():
            first.setdefault(v, i)
        for j in rows:
            head = first[rows[j]]
            if head != j:
                assert (r, head, j) in got
                continue
            for i in rows:
                if i < j and first[rows[i]] == i and m[i] @ m[j] >= 0.62 + 1e-9:
                    assert (r, i, j) in got


def plain_sections(alike, apart):
    groups = [[i] for i in range(len(alike))]
    while len(groups) > 1:
        near = [(alike[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        best, i, j = max(near)
        if best < 1 - apart:
            break
        groups[-i] += groups.pop(-j)
    return {frozenset(g) for g in groups}


def test_merges_are_average_linkage(weighted):
    vectors = matrix(weighted, 1, 60)[:30]
    alike = np.clip(vectors @ vectors.T, 0, 1)
    for apart in (0.55, 0.7, 0.9):
        found: dict = {}
        for note, cluster in enumerate(se._labels(vectors, [1 - apart])[0]):
            found.setdefault(cluster, set()).add(note)
        assert {frozenset(g) for g in found.values()} == plain_sections(alike, apart)


def test_dedupe_notes_keeps_the_fuller_and_the_earlier(spark):
    rows = [(1, 0, "the dashboard shows the budget", 60_000), (1, 1, "the dashboard shows the budget today", 30_000),
            (1, 2, "a new server for the customer", 90_000), (1, 3, "the dashboard shows the budget", 120_000)]
    n = spark.createDataFrame(rows, "recording_id long, note_no long, text string, ts_start_ms long")
    out = se.dedupe_notes(n, tm.weights(n, None, ("note_no",)), same=0.5).orderBy("note_no").collect()
    assert [(x["note_no"], x["text"], x["ts_start_ms"]) for x in out] == [
        (0, "the dashboard shows the budget today", 30_000), (2, "a new server for the customer", 90_000)]


def test_sections_are_the_same_in_a_task_and_over_the_cluster(sentences, weighted):
    notes = sentences.where("sent_no < 25").withColumnRenamed("sent_no", "note_no")
    w = tm.weights(notes, None, ("note_no",)).cache()

    def groups(task_notes):
        out: dict = {}
        for x in se.discover_sections(notes, w, apart=0.7, task_notes=task_notes).collect():
            out.setdefault((x["recording_id"], x["section"]), set()).add(x["note_no"])
        return {(k[0], frozenset(v)) for k, v in out.items() }

    assert groups(2000) == groups(3)
