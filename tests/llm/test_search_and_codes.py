"""Ranked search by bags, BPE by chunks and integer vector codes: against plain versions, and with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import chunks, codes, lexical, queries
from colloquy.plans.store import materialise
from test_llm import DOCS, LONG, ODD, SMALL, folder, none, odd, rows  # noqa: F401 - fixtures

WORDS = public_tokenizers.path("word_bpe_49k.json")


# 11: ranked search

def plain_search(docs, items, best=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(i, w) for i, t in docs if (w := find((t or "").translate(low)))]
    texts, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(find((text or "").translate(low)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, w in held:
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * texts) // total
            score = sum(math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda r: (r[0], r[1], r[2] or 0))[:best], 1)]
    return sorted(out, key=str)


def test_search_against_plain(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(queries.op11(spark, SMALL), "item_id", "rank", "doc_id", "score")
    assert got == plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("block", [1 << 18, 3])
def test_search_odd(spark, odd, none, monkeypatch, block):
    """Ties, repeats, null ids and texts; many blocks of items find what one does."""
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    asked = [(1, "Alpha gamma"), (2, "lorem ipsum"), (2, "ÄRGER épsilon"), (3, None), (4, " ... "), (None, "a b"), (5, "one"), (6, "alpha alpha zzz")]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumn("rank", F.lit("x"))
    more = spark.createDataFrame([(30 - i, "a b c") for i in range(25)] + [(40, "Ärger épsilon ärger")], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    got = rows(lexical.search(docs, items), "item_id", "rank", "doc_id", "score")
    assert got == plain_search([(i, t) for i, t, *_ in ODD] + [(30 - i, "a b c") for i in range(25)] + [(40, "Ärger épsilon ärger")], asked)
    tied = [d for _, _, d, _ in sorted((g for g in got if g[0] is None), key=lambda g: g[1])]
    assert len(tied) == 10 and tied == [*sorted(tied[:2]), *sorted(tied[2:])]       # two shorter texts, then the equal ones by id
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_classes_keep_the_smallest_ids(spark):
    bags = spark.createDataFrame([(i, 3, [0, 1], [1, 2]) for i in range(100, 0, -1)] + [(None, 3, [0, 1], [1, 2])] * 3 + [(7, 3, [0, 1], [2, 1])],
                                 "doc_id long, n long, terms array<int>, counts array<int>").repartition(4)
    got = {tuple(r.counts): sorted(r.ids) for r in lexical.classes(bags, 101, 303).collect()}
    assert got == {(1, 2): list(range(1, 11)), (2, 1): [7]}


# 12: BPE by chunks

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cuts_are_content_defined():
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefghij klmnoé中") for _ in range(20000)).encode()
    one, two = chunks.cuts([b"x" * 700 + shared, b"completely different " * 9 + shared])
    assert b"".join(one) == b"x" * 700 + shared and b"".join(two).endswith(shared)
    assert len(set(one) & set(two)) > len(one) - 4
    for piece in one:
        assert len(piece) <= chunks.GREATEST and piece.decode()
    assert list(chunks.cuts([b"", b"a", "中".encode() * 9000])) [:2] == [[], [b"a"]]


def test_joins_equal_the_whole_text(library):
    """A text cut at every place gives the ids of the whole, pieces without a gap included."""
    words = chunks.Words(WORDS)
    for text in ("I'll go, don't stop. 3.14 é ÅΣς", "<|endoftext|>a <|start|>", "nogap中文", " \n lead", "trail \x1c x\x85y "):
        for size in (1, 2, 3, 5):
            made = None
            for i in range(0, len(text), size):
                run = chunks.run_of(text[i:i + size], words)
                made = chunks.join(made, run, words) if made else run
            assert np.frombuffer(chunks.finish(made, words), words.code).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunked_ids_equal_the_library(spark, odd, none, library):
    rng = random.Random(1)
    bits = ["a", "b", "the ", "Don't", "I'll ", "<|endoftext|>", "<|startoftext|>x", " ", "\n\t", "\x1c", "\x85", "\xa0", "　", "é", "é", "́", "ÅΣς", "İ",
            "中文字", "12", "3.5", "!?", "\U0001f600", "ﬁ", "​", "'s", "'", "ｆ", "Straße", "ŉ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 600))) for _ in range(60)]
    made = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[3] * 4 + f"tail{i}") for i in range(40)] + [(900, "中文" * 20000), (901, "中文" * 20000), (902, "ab" * 50000)]
    more = spark.createDataFrame(made, "doc_id long, text string")
    docs = materialise(odd.unionByName(more, allowMissingColumns=True))
    got = rows(chunks.round_trip(docs, WORDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted([(i, *digests(library, t)) for i, t, *_ in ODD] + [(i, *digests(library, t)) for i, t in made], key=str)
    assert chunks.encode(none, WORDS).count() == 0


def test_hot_chunks_are_dealt(spark, library, monkeypatch):
    """A passage in every text goes to several tasks; a filter that is full only makes more chunks travel."""
    monkeypatch.setattr(chunks, "FILTER_BITS", 64)
    monkeypatch.setattr(chunks, "HOT", 60)
    passage = " ".join(f"w{i}" for i in range(4000))
    texts = [(i, f"begin{i} {passage} end{i}") for i in range(30)]
    docs = materialise(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    assert max(chunks.shared_chunks(docs, "text").hot.values()) > 1
    assert rows(chunks.round_trip(docs, WORDS), "doc_id", "n_tokens") == sorted([(i, digests(library, t)[0]) for i, t in texts], key=str)


def test_vocabularies_with_blanks_in_pieces_are_refused():
    with pytest.raises(ValueError):
        chunks.Words(public_tokenizers.path("byte_bpe_50k.json"))


# 13: vector codes

def plain_codes(vectors):
    """``{place: (code, error)}`` and the codebooks, by all distances."""
    kept = [(k, [math.floor(1024 * float(x)) for x in v]) for k, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max([len(z) for _, z in kept] + [1]) // 4) * 4
    x = np.array([z + [0] * (width - len(z)) for _, z in kept], np.int64).reshape(len(kept), 4, width // 4)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:256]
    books = x[first].transpose(1, 0, 2).copy()

    def all_nearest():
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(4)]
        return [(a.argmin(axis=1), a.min(axis=1)) for a in d]
    for _ in range(4):
        for p, (at, _) in enumerate(all_nearest()):
            for e in set(at.tolist()):
                own = x[at == e, p]
                books[p, e] = own.sum(axis=0) // len(own)
    last = all_nearest()
    return [(kept[i][0], "".join(f"{at[i]:02x}" for at, _ in last), int(sum(d[i] for _, d in last))) for i in range(len(kept))], books


@pytest.mark.parametrize("length", [1, 2, 4, 8, 32])
def test_transform(length):
    rng = np.random.default_rng(length)
    rows_, eye = rng.integers(-999, 999, (5, length)), codes.transform(np.eye(length, dtype=np.int64))
    changes = (np.diff(eye.T, axis=1) != 0).sum(axis=1)
    assert changes.tolist() == list(range(length))
    a, b = codes.transform(rows_), codes.transform(rows_[::-1])
    assert (((a - b) ** 2).sum(axis=1) == length * ((rows_ - rows_[::-1]) ** 2).sum(axis=1)).all()


@pytest.mark.parametrize("width", [1, 3, 16])
def test_nearest_is_exact_with_ties(width):
    rng = np.random.default_rng(width)
    x, e = rng.integers(-3, 4, (3000, width)), rng.integers(-3, 4, (200, width))
    at, error = codes.nearest(codes.transform(x), codes.transform(e))
    d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_codes_against_plain(spark):
    got = queries.op13(spark, SMALL).collect()
    held = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    want, books = plain_codes([(r.vec_id, r.embedding) for r in held])
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want) and {r.codebooks_sha256 for r in got} == {codes.digest(books)}
    label = {r.vec_id: r.label for r in held}
    sums = Counter()
    for k, _, error in want:
        sums[label[k]] += error
    assert all(r.label_error == sums[label[r.vec_id]] for r in got)


def test_codes_odd(spark):
    held = [(1, [0.5, 0.25, 1.0, -1.0, 0.1], 1), (1, [0.5, 0.25, 1.0, -1.0, 0.1], None), (2, [0.0] * 8, None), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan")] * 4, 1),
            (6, [float("inf")], 2), (None, [0.3, -0.0004, 0.2], 2), (7, [], 2), (8, [-0.5] * 8, 3)]
    df = spark.createDataFrame(held, "vec_id long, embedding array<float>, label int").withColumn("z", F.lit("x")).withColumn("key", F.lit("x")).withColumn("error", F.lit("x"))
    got = codes.code_table(df).collect()
    want, books = plain_codes([(k, [np.float32(x) if x is not None else None for x in v] if v is not None else None) for k, v, _ in held])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=str) == sorted(want, key=str) and got[0].codebooks_sha256 == codes.digest(books)
    assert codes.code_table(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        codes.code_table(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<double>, label int"))
