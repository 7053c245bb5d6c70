"""Lining up two word sequences by position.

Words that are unique on both sides of a recording are anchors. Anchors that cross others are left out (the longest
rising chain stays, found in blocks), the rest cut the recording into gaps, and words are matched inside their gap
only: as many as can be, of those as many spelled alike as can be, in as few pieces as can be. Gaps that are still long
get anchors of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans.ordered import dense, in_order
from colloquy.plans.store import materialise

REC = ["recording_id"]
#: Anchors of a block, and words of a gap side that are matched as they are.
BLOCK, GAP = 4096, 1024
#: Heard words whose gaps are matched in one call; each brings at most ``GAP`` words of a side.
NEAR = 2048


def rising(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Places of a longest (heaviest) strictly rising subsequence, of several the one that ends lowest."""
    if weights is None:
        ends: list = []
        at: list[int] = []
        before = np.full(len(values), -1, np.int64)
        for i, v in enumerate(values.tolist()):
            k = bisect_left(ends, v)
            before[i] = at[k - 1] if k else -1
            ends[k:k + 1], at[k:k + 1] = [v], [i]
        last = at[-1] if at else -1
    else:       # the heaviest chain that ends in each value: a tree of running maxima over the values' ranks
        order = {v: k + 1 for k, v in enumerate(sorted(set(values.tolist())))}
        tree: list[tuple] = [(0, -1)] * (len(order) + 1)
        before, best, last = np.full(len(values), -1, np.int64), 0, -1
        for i, (v, w) in enumerate(zip(values.tolist(), weights.tolist())):
            k, found = order[v] - 1, (0, -1)
            while k:
                found, k = max(found, tree[k], key=lambda x: x[0]), k & (k - 1)
            before[i], own, k = found[1], found[0] + w, order[v]
            while k < len(tree):
                if own > tree[k][0]:
                    tree[k] = (own, i)
                k += k & -k
            if own > best:
                best, last = own, i
    chain = []
    while last >= 0:
        chain.append(last)
        last = before[last]
    return np.array(chain[::-1], np.int64)


def _chain(pairs: DataFrame) -> DataFrame:
    """A rising chain of ``pairs(recording_id, gap, hn, gn)`` within each gap: rows of it, from whole blocks of anchors.

    Each block of 4,096 anchors gives its longest chain and the middle of it. The heaviest rising chain of the middles
    says which blocks stand in order; between two such middles the chains of both halves are settled once more.
    A gap of a billion anchors has 250,000 middles, which is what one task ever holds of it.
    """
    keys = ["recording_id", "gap"]
    rec = f"recording_id {pairs.schema['recording_id'].dataType.simpleString()}, gap long"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hn")
        kept = pdf.iloc[rising(pdf["gn"].to_numpy())]
        return kept.assign(size=len(kept), mid=np.arange(len(kept)) == len(kept) // 2)

    blocks = dense(pairs, keys, ["hn"], "k").withColumn("blk", F.floor(F.col("k") / BLOCK)).drop("k")
    own = materialise(blocks.select("recording_id", "gap", "hn", "gn", "blk").groupBy(*keys, "blk").applyInPandas(first, f"{rec}, hn long, gn long, blk long, size long, mid boolean"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hn")
        pdf = pdf.iloc[rising(pdf["gn"].to_numpy(), pdf["size"].to_numpy())]
        low, high = pdf["gn"].to_numpy(), np.append(pdf["gn"].to_numpy()[1:], np.iinfo(np.int64).max)
        return pdf[["recording_id", "gap", "blk"]].assign(below=np.append(-1, low[:-1]), middle=low, above=high)

    chosen = own.where("mid").select("recording_id", "gap", "hn", "gn", "blk", "size").groupBy(*keys).applyInPandas(
        order, f"{rec}, blk long, below long, middle long, above long")
    # The first half of a block's chain meets the second half of the chosen block before it.
    rank = chosen.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("blk")))
    rows = own.join(rank, [*keys, "blk"]).withColumn("slot", F.col("place") - (F.col("gn") < F.col("middle")).cast("int"))
    rows = rows.where("gn > below AND gn < above")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hn")
        # The middle that opens a slot is its lowest value and comes first in it, so the longest chain can hold it.
        return pdf.iloc[rising(pdf["gn"].to_numpy())]

    return rows.select("recording_id", "gap", "hn", "gn", "slot").groupBy(*keys, "slot").applyInPandas(
        again, f"{rec}, hn long, gn long, slot int").select("recording_id", "hn", "gn")


def _gaps(words: DataFrame, pairs: DataFrame | None, side: str) -> DataFrame:
    """``words(recording_id, n, f)`` without the settled ones, with the number of the heard word whose anchor comes last before each."""
    if pairs is None:
        return words.withColumn("gap", F.lit(-1).cast("long"))
    own = pairs.select("recording_id", F.col(side).alias("n"), F.col("hn").alias("anchor"))
    met = materialise(words.join(own, ["recording_id", "n"], "left"))
    last = in_order(met, REC, ["n"], last={"gap": F.col("anchor")})
    return last.where("anchor is null").select(*words.columns, F.coalesce("gap", F.lit(-1).cast("long")).alias("gap"))


def _anchors(heard: DataFrame, given: DataFrame, beside: bool = False) -> DataFrame:
    """``(recording_id, gap, hn, gn)``: words unique on both sides of their gap; ``beside`` the same word on one hand at least, if asked."""
    def once(df, name):
        known = [F.min(c).alias(f"{name}_{c}") for c in ("p", "x")] if beside else []
        return (df.where("f <> ''").groupBy("recording_id", "gap", "f").agg(F.count("*").alias("c"), F.min("n").alias(name), *known).where("c = 1").drop("c"))
    met = once(heard, "hn").join(once(given, "gn"), ["recording_id", "gap", "f"])
    if beside:
        met = met.where("hn_p <=> gn_p OR hn_x <=> gn_x")
    return met.select("recording_id", "gap", "hn", "gn")


#: What an alignment counts, each more than all of the next together: equal words, those of one spelling, breaks, near words.
_EQUAL, _SPELLED, _BREAK, _NEAR = 1 << 48, 1 << 32, 1 << 16, 1
#: Letters that a word needs for one letter off to leave it the same word.
_LONG = 6


def _alike(a: str, b: str) -> bool:
    """Whether one of two different words begins the other, or they are long and one letter apart."""
    if not a or not b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if b.startswith(a):
        return True
    if len(a) < _LONG or len(b) - len(a) > 1:
        return False
    i = next(k for k, x in enumerate(a) if x != b[k])
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _near_words(a: list[str], b: list[str], score: np.ndarray) -> None:
    """Marks words of both sides that are alike; such words share their first letter or their last."""
    others, both = defaultdict(list), set(a) & set(b)
    for j, w in enumerate(b):
        if w and w not in both:
            others[w[0], 0].append(j)
            others[w[-1], 1].append(j)
    for i, w in enumerate(a):
        if w and w not in both:
            for j in {*others[w[0], 0], *others[w[-1], 1]}:
                if _alike(w, b[j]):
                    score[i, j] = _NEAR


def blocks_of(a: list[str], b: list[str], spelled_a: np.ndarray | None = None, spelled_b: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """``(i, j, equal)``: words that are equal, and words opposite each other where both sides have others instead.

    Of all alignments one with the most equal words; of those the most words of one spelling (``spelled_a``, ``spelled_b``), then the
    fewest runs that only one side has, then the most words opposite one that is nearly theirs; then the earliest.
    """
    if not set(a) & set(b) and (len(a) == len(b) or min(len(a), len(b)) == 0):
        return [(i, i, False) for i in range(min(len(a), len(b)))]
    if a == b and (spelled_a is None or np.array_equal(spelled_a, spelled_b)):
        return [(i, i, True) for i in range(len(a))]
    number: dict[str, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in ws]) for ws in (a, b)]
    equal = codes[0][:, None] == codes[1][None, :]
    score = np.where(equal, _EQUAL, 0)
    if spelled_a is not None:
        score += np.where(equal & (spelled_a[:, None] == spelled_b[None, :]), _SPELLED, 0)
    _near_words(a, b, score)
    # The best that ends with both words, with one of a only, with one of b only.
    m, n, never = len(a), len(b), -(1 << 60)
    met, only_a, only_b = (np.full((m + 1, n + 1), never, np.int64) for _ in range(3))
    met[0, 0] = 0
    only_b[0, 1:] = -_BREAK
    for i in range(1, m + 1):
        before = np.maximum(met[i - 1], only_b[i - 1])
        np.maximum(only_a[i - 1], before - _BREAK, out=only_a[i])
        np.maximum(before, only_a[i - 1], out=before)
        met[i, 1:] = before[:-1] + score[i - 1]
        only_b[i, 1:] = np.maximum.accumulate(np.maximum(met[i], only_a[i]))[:-1] - _BREAK
    out, i, j, last = [], m, n, None
    while i or j:
        if last is None:        # a run of one side comes after words opposite each other
            last = max((only_b, only_a, met), key=lambda t: t[i, j])        # noqa: B023
        if last is met:
            i, j, last = i - 1, j - 1, None
            out.append((i, j, bool(equal[i, j])))
        elif last is only_a:
            i, last = i - 1, only_a if only_a[i - 1, j] == only_a[i, j] else None
        else:
            j, last = j - 1, only_b if only_b[i, j - 1] == only_b[i, j] else None
    return out[::-1]


def _matched(heard: DataFrame, given: DataFrame, gap: int) -> DataFrame:
    """``(recording_id, hn, gn, equal)`` inside each gap; what is longer than ``gap`` words (and has no anchor) is matched piece by piece."""
    kind = heard.schema["recording_id"].dataType.simpleString()
    spelled = "spelled" in heard.columns and "spelled" in given.columns
    kept = ["n", "f", *(["spelled"] if spelled else [])]

    def numbered(df, side):
        # Number within the gap: its first word is known once per gap, and words between two anchors are consecutive.
        first = df.groupBy("recording_id", "gap").agg(F.min("n").alias("first"))
        return df.join(first, ["recording_id", "gap"]).select("recording_id", "gap", F.floor((F.col("n") - F.col("first")) / gap).alias("piece"), F.lit(side).alias("heard"), *kept)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gap", "n"])
        gaps, side, n, f = (pdf[c].to_numpy() for c in ("gap", "heard", "n", "f"))
        as_is = pdf["spelled"].to_numpy() if spelled else None
        starts = np.flatnonzero(np.append(True, gaps[1:] != gaps[:-1]))
        found = []
        for low, high in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            mine = side[low:high]
            hn, hf, gn, gf = n[low:high][mine], f[low:high][mine], n[low:high][~mine], f[low:high][~mine]
            if len(hn) and len(gn):
                own = (None, None) if as_is is None else (as_is[low:high][mine], as_is[low:high][~mine])
                found += [(hn[i], gn[j], equal) for i, j, equal in blocks_of(hf.tolist(), gf.tolist(), *own)]
        out = pd.DataFrame(found, columns=["hn", "gn", "equal"]).astype({"hn": "int64", "gn": "int64", "equal": bool})
        out.insert(0, "recording_id", pdf["recording_id"].iloc[:1].repeat(len(found)).to_numpy())
        return out

    # Gaps that only one side has words in are left out before anything is shuffled by gap.
    shared = heard.select("recording_id", "gap").distinct().join(given.select("recording_id", "gap").distinct(), ["recording_id", "gap"])
    both = numbered(heard, True).unionByName(numbered(given, False)).join(shared, ["recording_id", "gap"], "left_semi")
    # Neighbouring gaps share a call: most hold a few words, far less than a call costs.
    both = both.withColumn("near", F.floor(F.col("gap") / NEAR))
    return both.groupBy("recording_id", "near", "piece").applyInPandas(settle, f"recording_id {kind}, hn long, gn long, equal boolean")


def align(heard: DataFrame, given: DataFrame, gap: int = GAP) -> DataFrame:
    """``(recording_id, hn, gn, equal)`` for ``heard`` and ``given (recording_id, n, f)``: pairs rise on both sides.

    ``equal`` where the words agree; otherwise the words stand opposite each other in a run that both sides word differently.
    ``n`` is dense from 0. Null words count as empty; an empty word is never an anchor. Where both sides have a number ``spelled``,
    words that agree in it too are preferred to others that are equal.
    """
    def own(df):
        spelled = [F.coalesce("spelled", F.lit(0).cast("long")).alias("spelled")] if "spelled" in df.columns else []
        return df.select("recording_id", F.col("n").cast("long").alias("n"), F.coalesce("f", F.lit("")).alias("f"), *spelled)

    # A word that is unique on both sides may still be two words, one of which the other side lacks: at first a neighbour has to agree.
    word = F.xxhash64("f")
    placed = [materialise(in_order(own(df), REC, ["n"], lag={"p": word}, lead={"x": word})) for df in (heard, given)]
    heard, given = (df.drop("p", "x") for df in placed)
    new = materialise(_chain(materialise(_anchors(*(_gaps(df, None, "n") for df in placed), beside=True))))
    pairs, open_gaps = None, None
    while True:
        if open_gaps is not None:
            new = materialise(_chain(materialise(_anchors(*(df.join(open_gaps, ["recording_id", "gap"], "left_semi") for df in (h, g))))))
            if new.isEmpty():
                break
        pairs = new if pairs is None else materialise(pairs.unionByName(new))
        h, g = materialise(_gaps(heard, pairs, "hn")), materialise(_gaps(given, pairs, "gn"))
        sizes = h.groupBy("recording_id", "gap").agg(F.count("*").alias("a")).join(g.groupBy("recording_id", "gap").agg(F.count("*").alias("b")), ["recording_id", "gap"])
        open_gaps = materialise(sizes.where(F.greatest("a", "b") > gap).select("recording_id", "gap"))
        if open_gaps.isEmpty():
            break
    inside = _matched(h, g, gap)
    return pairs.withColumn("equal", F.lit(True)).unionByName(inside)
