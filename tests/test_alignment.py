"""Lining up words by position, and what it may respell."""

import random
import time

import numpy as np
import pytest

from colloquy.operators import alignment, proofread


def table(spark, texts):
    rows = [(r, n, w) for r, text in texts.items() for n, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "recording_id long, n long, word string")


#: Heard, given, and the words that change.
CASES = [       # a capital stays where it may be a name's
    ("citta e universita restano aperte", "Città e università restano aperte.", {0: "Città", 2: "università"}),       # accents come back
    ("oggi parla ferrantti del consiglio", "Oggi parla Ferranti del consiglio.", {0: "Oggi", 2: "Ferranti"}),                      # a name, one letter off
    ("seguono le registraz complete", "Seguono le registrazioni complete.", {0: "Seguono", 2: "registrazioni"}),                      # a word cut short
    ("poi dopo il voto usciamo", "Poi dopo il voto usciamo. Si vota dopo.", {}),                                         # a sentence's capital stays out
    ("la spesa e deliberata", "La scelta è deliberata.", {2: "è"}),                                                     # another word stands
    ("buonasera a voi", "Buonasera a voi. Grazie di essere venuti fin qui.", {0: "Buonasera"}),                                       # what was never said is not added
    ("il conto e chiuso e dico due parole mie", "Il conto è chiuso.", {2: "è"}),                                        # what was improvised stays
    ("nel corpo di oggi", "Nel corso di oggi.", {0: "Nel"}),                                                                    # short words: no guessing
    ("permesso concesso stasera", "Premesso concesso stasera.", {}),                                                    # two edits
    ("le decisione del gruppo", "Le decisioni del gruppo.", {}),                                                        # an ending is heard
    ("usiamo postgressql ogni volta", "Usiamo PostgreSQL ogni volta.", {0: "Usiamo", 1: "PostgreSQL"}),                              # inside a long word
    ("prima andiamo al mare poi torniamo a casa presto", "poi torniamo a casa presto in sala per a punti e basta", {}),  # opposite nothing
    ("perché PERCHE", "perche perché", {0: "perche", 1: "Perché"}),
    ("", "Buongiorno.", {}), ("buongiorno a tutti", "", {}), ("il saldo e fermo", "Farina, uova e latte.", {})]


def test_what_the_text_may_fix(spark):
    heard, given = (table(spark, {i: case[k] for i, case in enumerate(CASES)}) for k in (0, 1))
    got = {i: {} for i in range(len(CASES))}
    for r in proofread.respell_by_position(heard, given).collect():
        got[r.recording_id][r.n] = r.fixed
    assert got == {i: case[2] for i, case in enumerate(CASES)}


def test_the_report_counts_words_that_agree_in_order(spark):
    heard, given = table(spark, {1: "a b c d", 2: "uno due tre quattro"}), table(spark, {1: "d c b a", 2: "Uno due, tre cinque quattro", 3: "nessuno"})
    pairs, fixes = proofread.aligned(heard, given), proofread.respell_by_position(heard, given)
    got = {r.recording_id: r for r in proofread.reference_report_by_position(heard, given, fixes, pairs).collect()}
    assert (got[1].heard, got[1].given, got[1].matched, got[1].poor) == (4, 4, 1, True)
    assert (got[2].matched, got[2].coverage, got[2].corrected) == (4, 0.8, 0) and (got[3].heard, got[3].matched) == (0, 0)


@pytest.mark.parametrize("weighted", [False, True])
def test_rising(weighted):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 12):
        for _ in range(30):
            values, weights = rng.permutation(n), rng.integers(1, 4, n) if weighted else np.ones(n, np.int64)
            best = max((sum(weights[i] for i in range(n) if mask >> i & 1) for mask in range(1 << n)
                        if (np.diff(values[[i for i in range(n) if mask >> i & 1]]) > 0).all()), default=0)
            kept = alignment.rising(values, weights if weighted else None)
            assert (np.diff(values[kept]) > 0).all() and (np.diff(kept) > 0).all() and weights[kept].sum() == best


#: Heard, given, and the heard words that have the given ones opposite them: what only one side has stands before, after or between.
APART = [
    ("uno re es cosa ultima Es tre due", "uno Es tre due", {0: 0, 5: 1, 6: 2, 7: 3}),                # the one spelled alike, not the first
    ("uno to. Altro vero the. To to. due", "uno to. To to. due", {0: 0, 1: 1, 5: 2, 6: 3, 7: 4}),     # as many as can be
    ("uno bel giorno toorrow due tre", "uno tomorrow due tre", {0: 0, 3: 1, 4: 2, 5: 3}),              # opposite the word that is nearly it
]


@pytest.mark.parametrize("heard, given, opposite", APART)
def test_what_one_side_lacks_takes_no_word(heard, given, opposite):
    a, b = heard.split(), given.split()
    sides = [[w.lower().strip(".") for w in x] for x in (a, b)]
    spelled = [np.array([hash(w) for w in x]) for x in (a, b)]
    assert {i: j for i, j, _ in alignment.blocks_of(*sides, *spelled)} == opposite


def test_a_unique_word_without_an_equal_neighbour_is_no_anchor(spark):
    """Heard lacks a letter of "ertible" and has that word elsewhere, where the text has none."""
    heard, given = "the heaton erible anlyor the eronha ertible heer the the onnd", "the heaton ertible anlyor the the onnd"
    rows = [[(1, n, w) for n, w in enumerate(x.split())] for x in (heard, given)]
    got = alignment.align(*(spark.createDataFrame(x, "recording_id long, n long, f string") for x in rows)).collect()
    assert {r.hn: r.gn for r in got}[2] == 2


def edited(rng, n, vocabulary):
    """A text, what was heard of it, and which words of both are the same."""
    given = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]
    heard, same = [], []
    for j, word in enumerate(given):
        roll = rng.random()
        if roll < 0.03:
            heard += [f"x{rng.randrange(9)}" for _ in range(rng.randrange(1, 4))]
        if roll > 0.05:
            if roll > 0.08:
                same.append((len(heard), j))
            heard.append(word if roll > 0.08 else word + "y")
    return heard, given, same


@pytest.mark.parametrize("blocks, gap", [(4096, 1024), (16, 8)])
def test_edited_texts_line_up(spark, monkeypatch, blocks, gap):
    """Pairs rise on both sides at any size of block and gap, and nearly all words that were kept are found."""
    monkeypatch.setattr(alignment, "BLOCK", blocks)
    rng = random.Random(11)
    made = {r: edited(rng, n, v) for r, n, v in ((1, 3000, 5000), (2, 400, 40), (3, 50, 3), (4, 1, 2))}
    moved = [f"m{i}" for i in range(300)]
    base = [f"b{i}" for i in range(1500)]
    made[5] = (base + moved, moved + base, [(i, i + 300) for i in range(1500)])     # a part that moved must not cost the rest
    rows = [[(r, n, w) for r, m in made.items() for n, w in enumerate(m[side])] for side in (0, 1)]
    heard, given = (spark.createDataFrame(x, "recording_id long, n long, f string").repartition(3) for x in rows)
    got = {r: [] for r in made}
    for r in alignment.align(heard, given, gap).collect():
        got[r.recording_id].append((r.hn, r.gn, r.equal))
    for r, (h, g, same) in made.items():
        pairs = sorted(got[r])
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert all((h[i] == g[j]) == e for i, j, e in pairs)
        found = sum(1 for i, j, e in pairs if e)
        assert found >= (0.93 if blocks == 4096 or r in (1, 5) else 0.5) * len(same)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "recording_id long, n long, f string")
    odd = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, "a")], "recording_id long, n long, f string")
    assert alignment.align(none, none).count() == 0 and alignment.align(odd, none).count() == 0
    assert sorted(tuple(r)[1:] for r in alignment.align(odd, odd).collect()) == [(0, 0, True), (1, 1, True), (2, 2, True)]


def test_many_short_gaps_share_calls(spark):
    """A call for each of these gaps took over a minute."""
    from pyspark.sql import functions as F
    words = spark.range(20_000).select(F.lit(1).cast("long").alias("recording_id"), "id", F.col("id").alias("gap"))
    heard = words.select("recording_id", (2 * F.col("id") + 1).alias("n"), F.lit("said").alias("f"), "gap")
    given = words.select("recording_id", (3 * F.col("id") + 1).alias("n"), F.when(F.col("id") % 2 == 0, "said").otherwise("meant").alias("f"), "gap")
    start = time.time()
    got = alignment._matched(heard, given, 1024).groupBy("equal").agg(F.count("*").alias("c"), F.sum(F.col("gn") * 2 - F.col("hn") * 3).alias("d")).collect()
    assert {r.equal: (r.c, r.d) for r in got} == {True: (10_000, -10_000), False: (10_000, -10_000)}
    assert time.time() - start < 20
