"""The training-data operators on small tables: against plain versions, and with nulls, ties, repeats and empty tables."""

import hashlib
import ipaddress
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import common, hnsw, huffman, minhash, packing, permutation, ring, surrogates, tokens, toxicity, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, "Alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "alpha  BETA gamma delta\nepsilon zeta", None, "a", 1), (2, "alpha  BETA gamma delta\nepsilon zeta", None, "a", 1), (3, None, "en", None, None),
       (4, "", "en", "b", 0), (5, "   \n ", "en", "b", 3), (6, LONG, "en", "a", len(LONG)), (7, LONG + "more", "en", "a", 1), (None, "one two three", None, None, None), (8, "a b", "en", "c", 3), (9, "A B", "en", "c", 3)]


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward row, with extra columns named like inner ones."""
    rows = spark.createDataFrame(ODD, DOCS)
    for name in ("row", "n", "id", "value", "score", "digest", "key", "size", "ids", "t", "made", "component"):
        rows = rows.withColumn(name, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# Components

def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 5), (3, 3), (7, 9), (9, 8), (None, 2)] + [(200, x) for x in range(201, 260)]
    got = dict(rows(common.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert {got[i] for i in range(100, 141)} == {100} and got[5] == got[3] == 3 and got[7] == got[8] == got[9] == 7
    assert {got[i] for i in range(200, 260)} == {200} and 2 not in got


# 1: toxicity

def test_machine_learns_a_pair():
    """A label that only the pair tells is learned: neither term does alone."""
    rng = np.random.default_rng(3)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    y = (a & b).astype(float)
    texts = [np.array(sorted([*([11] if p else []), *([22] if q else []), 33]), np.int32) for p, q in zip(a, b)]
    made = toxicity.fit(texts, y)
    at = made.index()
    says = lambda *t: made.score((r := at[np.array(t)])[r >= 0])
    assert says(11, 22) > 0.8 and says(11) < 0.2 and says(22) < 0.2 and says(33) < 0.2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    got = toxicity.judge(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.85


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 0), (6, 1)], "doc_id long, toxic int")
    got = toxicity.judge(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] == 7] == [zlib.crc32(b"7") % 4 == 2]
    assert toxicity.judge(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.judge(odd, labels.where("false")).collect()} == {0}


# 2: surrogates

def test_surrogates(spark, odd, none):
    text = ("Mr John Smith and Mr. Smith; ANN@MAIL.EXAMPLE.COM ann@mail.example.com; 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112; "
            "10.0.0.7 8.8.8.8; +1 (988) 555-2485, 988-555-2485; 123-45-6789; password=df197435077f02c99b; DE89370400440532013000")
    got = surrogates.pseudonymise(spark.createDataFrame([(1, text), (2, text), (3, text.lower()), (4, "Clean. 3.2.1 text")], "doc_id long, text string"), count="n")
    one, two, _, clean = (r["text"] for r in got.orderBy("doc_id").collect())
    assert one == two and clean == "Clean. 3.2.1 text"
    for gone in ("John", "Smith", "ann@", "ANN@", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.7", "8.8.8.8", "555-2485", "123-45", "df1974", "DE8937"):
        assert gone not in one
    assert "not 4111 1111 1111 1112" in one
    names, mails, cards, ips, phones, _, secret, iban = one.split("; ")
    assert names.split()[2] == names.split()[5] and names[0:3] == "Mr " and " Mr. " in names
    assert mails.split()[0] == mails.split()[1].upper() and mails.endswith(".com")
    first, second = cards.split(" and ")[0], cards.split(" and ")[1].split(",")[0]
    digits = first.replace(" ", "")
    assert digits == second.replace("-", "") and sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits))) % 10 == 0
    assert ips.startswith("10.") and all(0 <= int(x) < 256 for ip in ips.split() for x in ip.split("."))
    assert phones.split(", ")[0].startswith("+1 (") and [c for c in phones.split(", ")[0] if c.isdigit()][1:] == [c for c in phones.split(", ")[1] if c.isdigit()]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert secret.startswith("password=") and len(secret) == len("password=df197435077f02c99b")
    out = surrogates.pseudonymise(odd)
    assert out.columns == odd.columns and rows(out, "doc_id", "text") == rows(odd, "doc_id", "text")
    assert surrogates.pseudonymise(none).count() == 0


@pytest.mark.parametrize("length", [6, 512, 513, 700, 20_000])
def test_secrets_of_any_length(spark, length):
    secret = ("Ab3xK9" * (length // 6 + 1))[:length]
    text = f"x token = {secret} y"
    got = surrogates.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), count="n").first()
    made = got["text"].split()[3]
    assert got["n"] == 1 and len(got["text"]) == len(text) and got["text"].split()[::4] == ["x", "y"]
    assert not {secret[i:i + 12] for i in range(0, length - 11)} & {made[i:i + 12] for i in range(0, length - 11)} and made != secret


def test_cards_in_runs_phones_and_ipv6(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", "4111111111111111 12/27", f"no 17 {card}", f"{card} 555-123-4567", f"{card} 12 {card}", f"1 {card} 10.0.0.1", f"{card} 9 ann@x.com",
             "+49 30 1234567 +49 (30) 1234567", "+44 20 7946 0958", "555 123 4567 and 555-123-4567", "2001:db8::8a2e:370:7334 2001:0DB8:0000:0000:0000:8A2E:0370:7334", "at fe80::1.",
             "std::vector a::b 12:30:45; 1234 5678 9012 3451"]
    got = [(r["text"], r["n"]) for r in surrogates.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count="n").orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1, 1, 1, 2, 2, 2, 2, 2, 1, 2, 2, 1, 0]
    shape = lambda x: "".join("0" if c.isdigit() else c for c in x)
    assert [shape(t) for t, _ in got[:5]] == [shape(t) for t in texts[:5]]
    out = [t for t, _ in got]
    assert not [t for t in out for gone in (card, card.replace(" ", ""), "123-4567", "123 4567", "10.0.0.1", "ann@", "1234567", "7946", "8a2e", "fe80::1.") if gone in t]
    assert out[0].endswith(" 123") and out[1].endswith(" 12/27") and out[2].startswith("no 17 ") and out[4][:19] == out[4][-19:]
    digits = lambda x: "".join(filter(str.isdigit, x))
    assert digits(out[7])[:11] == digits(out[7])[11:] and digits(out[9])[:10] == digits(out[9])[10:] and out[12] == texts[12]
    one, two = (ipaddress.ip_address(a) for a in out[10].split())
    assert one == two and len(out[10].split()[1]) == 39


def test_surrogates_stay_distinct(spark):
    """A space of 26 short addresses is drawn again until no two are alike and none is real."""
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrst"]
    got = surrogates.draw(spark.createDataFrame([("email", m) for m in mails] + [("ip", "10.0.0.1"), ("ip", "10.0.0.2")], "kind string, entry string"), "k").collect()
    made = [r["made"] for r in got]
    assert len(set(made)) == len(made) == 22 and not set(made) & set(mails)


def test_a_full_block_of_addresses_is_left(spark):
    """With every address of 192.168 in use none can be drawn there."""
    full = spark.range(256 * 254).selectExpr("'ip' as kind", "concat('192.168.', id div 254, '.', id % 254 + 1) as entry")
    made = surrogates.draw(full.unionByName(spark.createDataFrame([("ip", "10.1.2.3")], "kind string, entry string")), "k").collect()
    assert len(made) == len({r.made for r in made}) == 256 * 254 + 1
    assert all(r.made.startswith("10.") for r in made)


def test_an_exhausted_space_ends_in_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "ATTEMPTS", 1)
    monkeypatch.setattr(surrogates, "surrogates", lambda entries, key: entries.withColumn("made", F.lit("same")))
    with pytest.raises(RuntimeError, match="ip"):
        surrogates.draw(spark.createDataFrame([("ip", "10.1.2.3"), ("ip", "10.1.2.4")], "kind string, entry string"), "k")


def test_planted_entries_are_gone(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    pattern = r"[\w.]+@mail\d\.example\.com"
    before = {m for r in docs.select(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m")).collect() for m in r["m"]}
    after = "\n".join(r["text"] for r in surrogates.pseudonymise(docs).select("text").collect())
    assert before and not any(m in after for m in before)


# 3: vectors

def plain_links(vectors, least):
    units = {k: np.array(v, float) / np.linalg.norm(v) for k, v in vectors}
    keys = sorted(units)
    links = {k: {j for j in keys if j != k and units[k] @ units[j] >= least} for k in keys}
    root = {}
    for k in keys:
        todo = [k] if k not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = k
                todo += links[x]
    return {k: (len(links[k]), root[k]) for k in keys}


def planted(n=700, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 16))
    out = [base[i % 60] + (0.08 if i % 3 else 0.6) * rng.normal(size=16) for i in range(n)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)] + [(n, [float(x) for x in out[0]])]


def test_vectors_against_all_pairs(spark):
    data = planted()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == plain_links(data, 0.95)


def test_graph_recall():
    rng = np.random.default_rng(1)
    units = permutation.normal(np.concatenate([rng.normal(size=(1500, 24)), rng.normal(size=(1, 24)) + 0.02 * rng.normal(size=(300, 24))]))
    graph = hnsw.Graph.build(units)
    q, r = hnsw.audited(graph, units, units, 0.95)
    got, want = set(zip(q.tolist(), r.tolist())), set(zip(*(x.tolist() for x in np.nonzero(units @ units.T >= 0.95))))
    assert got <= want and len(got) >= 0.999 * len(want)


def test_vectors_odd(spark):
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("v", F.lit(2))
    got = rows(hnsw.near_duplicates(frame), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)], (None, 0, None, False)], key=str)
    assert hnsw.near_duplicates(frame.where("false")).count() == 0


# 4 and 6: ids

def test_code_lengths_are_optimal():
    import heapq
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 1, 1])
    heap = [(int(c), i, [i]) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    plain = np.zeros(len(counts), int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        plain[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], 100 + len(heap), a[2] + b[2]))
    assert (huffman.lengths(counts) * counts).sum() == (plain * counts).sum()
    steep = np.array([2 ** i for i in range(40)])
    lens = huffman.lengths(steep, 8)
    assert lens.max() <= 8 and (2.0 ** -lens).sum() == 1
    assert huffman.lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


@pytest.mark.parametrize("sizes", [[0], [1], [256, 0, 257, 3], [5000, 1]])
def test_pack_and_unpack(sizes):
    rng = np.random.default_rng(2)
    counts = (rng.pareto(0.6, 3000) * 2).astype(np.int64)
    lens = huffman.lengths(counts)
    codes, bits, offsets, want, at = huffman.canonical(lens), [], [], [], 0
    for size in sizes:
        ids = rng.choice(np.flatnonzero(counts), size)
        data, own = huffman.pack(ids, lens, codes)
        bits.append(data), offsets.append(own + at * 8), want.append(ids)
        at += len(data)
    got = huffman.unpack(b"".join(bits), np.concatenate(offsets), huffman._runs(np.array(sizes)), huffman.decode_table(lens, codes))
    assert got.tolist() == np.concatenate(want).tolist()


def test_store_round_trip(spark, odd, none, tmp_path):
    huffman.write(odd, f"{tmp_path}/s", JSON, 2, partitions=3)
    got = huffman.read(spark, f"{tmp_path}/s").orderBy("start").collect()
    use, start = tokens.load(JSON), 0
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    texts = {i: t for i, t, *_ in ODD}
    for r in got:
        ids = use.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)
    assert huffman.store(none, JSON).count() == 0


def test_added_tokens_equal_a_plainly_loaded_tokenizer():
    plain, use = tokenizers.Tokenizer.from_file(JSON), tokens.Encoder(JSON)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z\n<|endoftext|>", "<|endoftext|", "a b"):
        assert np.frombuffer(use(text), use.width).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(use("a <|endoftext|> b"), use.width)


def test_ids_equal_the_library(spark, odd, none):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "  a", "a   b\n\n c \t d", "don't WE'LL 's", "x　 y\x85z \x1c w", "日本語 です", "😀👩‍👩‍👧", "A" * 3000, "<|endoftext|> x", "foo., bar!?.", None]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("ab'sé日\n\t  1²Ⅷ.!-_<"), 40)) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.round_trip(frame, RANKS).collect():
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert tokens.round_trip(odd, RANKS).count() == len(ODD) and tokens.round_trip(none, RANKS).count() == 0


def test_offsets_and_split_characters(spark):
    text = "né 😀 日本"
    r = tokens.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, offsets=True).first()
    table = tokens.byte_table(RANKS)
    assert b"".join(table[i] for i in r["ids"]) == text.encode()
    for byte, char in zip(r["byte_starts"], r["char_starts"]):
        assert len(text[:char].encode()) <= byte < len(text[:char + 1].encode())
    out, rest = "", b""
    for i in r["ids"]:      # one id at a time: characters split over ids come out whole
        part, rest = tokens.decode_text(np.array([i]), RANKS, rest)
        out += part
    assert out == text and rest == b""
    back = tokens.decode(tokens.encode(spark.createDataFrame([(1, None), (2, text)], "doc_id long, text string"), RANKS), RANKS)
    assert rows(back, "doc_id", "decoded") == [(1, bytearray(b"")), (2, bytearray(text.encode()))]


# 5: near duplicates of texts

def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_dedup(docs, percent):
    sets = {k: plain_sets(t) for k, t in docs}
    keys = sorted(sets)
    root = {k: k for k in keys}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_edge(spark, percent):
    """A set of up to 64 inside the largest set that it is near to, of which all values beyond the sketch are shared."""
    rng, docs, want = np.random.default_rng(6), [], set()
    for n in (56, 60, 62, 63, 64):
        m = n * 100 // percent
        for _ in range(2000):
            words = [f"w{x}" for x in rng.integers(0, 10**6, m + 4)]
            large, small = (minhash.shingles(" ".join(w)) for w in (words, words[:n + 4]))
            if len(large) == m and len(small) == n and len(set(large[:64]) & set(small)) == min(n, n - (m - 64)):
                docs += [" ".join(words), " ".join(words[:n + 4])]
                want.add((len(docs) - 2, len(docs) - 1))
                break
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), percent=percent).collect()}
    assert want and all(got[a] == got[b] for a, b in want)
    own = spark.range(1, 65).select("id", minhash._least_overlap(F.col("id"), percent).alias("k")).collect()
    least = lambda n, m: -(-percent * (n + m) // (100 + percent)) - max(0, m - 64)
    assert all(r["k"] == max(1, min(least(r["id"], m) for m in range(-(-r["id"] * percent // 100), r["id"] * 100 // percent + 1))) for r in own)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_all_pairs(spark, percent, monkeypatch):
    """Chains of edits, a passage that many share, and lists longer than a block."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    passage, docs = word(55), []
    for g in range(25):
        base = word(int(rng.integers(3, 160)))
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[rng.integers(0, len(own))] = f"x{rng.integers(0, 10**6)}"
            docs.append(" ".join(own))
    docs += [" ".join(passage + word(int(rng.integers(0, 60)))) for _ in range(60)]
    base = word(120)
    for i in range(80):
        own = list(base)
        own[rng.integers(0, 120)] = f"y{i}"
        docs.append(" ".join(own))
    data = list(enumerate(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), percent=percent).collect()}
    assert got == plain_dedup(data, percent)


def test_near_duplicates_odd(spark, odd, none):
    got = rows(minhash.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 5, 6, True), (7, 6, 7, True) if 100 * 5 < 85 * 6 else (7, 6, 6, False),
                          (None, 1, None, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.deduplicate(odd).columns == odd.columns and minhash.deduplicate(none).count() == 0
    assert minhash.deduplicate(odd.where("doc_id = 2")).count() == 1


# 7: the ring

def plain_ring(keys, shards, room):
    """Rows one at a time: own shards first in ring order, then clockwise."""
    points, placed = ring.points(shards, 64), {}
    room = list(room)
    position = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)
    arc = lambda k: next((i for i, (p, _) in enumerate(points) if p >= position(k)), 0)
    order = sorted(keys, key=lambda k: (arc(k), position(k) <= points[0][0], position(k)))
    late = []
    for k in order:
        shard = points[arc(k)][1]
        if room[shard]:
            room[shard] -= 1
            placed[k] = shard
        else:
            late.append(k)
    for k in late:
        at = arc(k)
        while True:
            at = (at + 1) % len(points)
            if room[points[at][1]]:
                room[points[at][1]] -= 1
                placed[k] = points[at][1]
                break
    return placed


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_against_plain(spark, slack):
    keys = list(range(500))
    got = dict(rows(ring.place(spark.range(500).withColumnRenamed("id", "doc_id"), 16, slack=slack), "doc_id", "shard"))
    assert got == plain_ring(keys, 16, ring.capacities(500, 16, slack))


def test_ring_moves_little(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    at = [dict(rows(ring.place(docs, n, slack=0.25), "doc_id", "shard")) for n in (16, 17)]
    assert sum(at[0][k] != at[1][k] for k in at[0]) < 0.25 * 4000        # all would move without a ring


def test_ring_odd(spark, odd, none):
    got = ring.shard_documents(odd).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == len(ODD) and sizes["count"].max() == 1 and set(sizes["min"]) == {0}
    assert got[got.doc_id == 3]["size"].tolist() == [1] and got[got.doc_id == 6].text_crc32.tolist() == [zlib.crc32(LONG.encode())]
    copies = ring.shard_documents(spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))).toPandas()       # one row, a thousand times
    assert copies.groupby("shard").size().between(62, 63).all() and not copies.duplicated(["shard", "slot"]).any()
    assert ring.shard_documents(none).count() == 0


# 8: the permutation index

def test_footrule():
    rng = np.random.default_rng(6)
    units, pivots = permutation.normal(rng.normal(size=(50, 8))), permutation.normal(rng.normal(size=(20, 8)))
    index = permutation.Index(units, pivots)
    orders = permutation.order(units, pivots)
    for q in range(5):
        places = permutation.order(units[q:q + 1], pivots)[0]
        far = lambda o, p: o.tolist().index(p) if p in o else permutation.PREFIX
        want = [sum(abs(far(places, p) - far(o, p)) for p in set(places) | set(o)) for o in orders]
        assert index.footrule(places).tolist() == want


def test_nearest_recall_and_order(spark):
    data = planted(1200, 8)
    got = permutation.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).toPandas()
    v = {k: np.array(x) for k, x in data}
    hit = total = 0
    for q in [k for k in v if k % 50 == 0]:
        near = sorted(((-permutation.cosine(v[k], v[q]), k) for k in v if k != q))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.tolist() == [permutation.cosine(v[k], v[q]) for k in own.vec_id]
        hit, total = hit + len(set(own.vec_id) & {k for _, k in near}), total + 5
    assert hit >= 0.95 * total


def test_nearest_odd(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("dim", F.lit(9))
    got = rows(permutation.nearest(frame), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert permutation.nearest(frame.where("false")).count() == 0


# 9: WARC

def test_archives(spark, tmp_path):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4
    pages = [(5, "http://a.example/x?y=1#z", trap), (3, "http://b.example/", trap), (3, "http://b.example/", trap), (1, None, None), (2, "bad\r\nurl 100%", "short"), (4, None, "short"), (None, "http://c.example", trap), (7, "u", "é" * 50), (8, "u", "é" * 50)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    warc.write(frame, f"{tmp_path}/w")
    captured = warc.assemble(warc.read(spark, f"{tmp_path}/w")).cache()
    got = rows(warc.page_table(captured), "page_id", "payload_bytes", "record_type", "refers_to", "url", "payload_digest")
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    n = len(trap)
    assert got == sorted([(5, n, "revisit", 3, pages[0][1], sha(trap)), *[(3, n, "response", None, pages[1][1], sha(trap))] * 2, (1, 0, "response", None, None, sha("")), (2, 5, "response", None, pages[4][1], sha("short")),
                          (4, 5, "response", None, None, sha("short")), (None, n, "revisit", 3, pages[6][1], sha(trap)), (7, 100, "response", None, "u", sha("é" * 50)), (8, 100, "revisit", 7, "u", sha("é" * 50))], key=str)
    bodies = {r["page"]: bytes(r["payload"]) for r in captured.select(F.element_at("metadata.fields", F.lit("page-id")).alias("page"), "response.payload").collect()}
    assert bodies["3"] == trap.encode() and bodies["5"] == b"" and bodies["2"] == b"short"
    assert all(r["request"] and r["metadata"] for r in captured.collect())
    assert warc.captures(frame.where("false")).count() == 0


def test_garbled_payloads_show(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 200), (2, "v", "a" * 200)], "page_id long, url string, html string")
    text = "".join(r[0] + warc.RECORD_END for r in warc.captures(pages).collect()).replace("a" * 200, "a" * 199 + "b")
    (tmp_path / "g.warc").write_bytes(text.encode())
    got = rows(warc.page_table(warc.assemble(warc.read(spark, f"{tmp_path}/g.warc", payloads=False))), "page_id", "payload_bytes", "payload_digest", "record_type")
    sha = hashlib.sha256(b"a" * 199 + b"b").hexdigest()
    assert got == [(1, 200, sha, "response"), (2, 200, sha, "revisit")]


# 10: packing

def plain_best_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if b["used"] < capacity and capacity - b["used"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
        out.append((at, bins[at]["used"]))
        bins[at]["used"] += size
        bins[at]["sources"].add(source), bins[at]["clusters"].add(cluster)
    return out


def test_best_fit_against_plain():
    rng = np.random.default_rng(9)
    for _ in range(20):
        items = [(int(rng.integers(1, 60)), f"s{min(int(rng.exponential(3)), 12)}", int(rng.integers(0, 40))) for _ in range(300)]
        assert packing.best_fit(*zip(*items), 100) == plain_best_fit(items, 100)


@pytest.mark.parametrize("sources, none", [(1300, 0.0), (3, 0.9), (700, 0.3)])
def test_best_fit_with_many_sources_and_none(sources, none):
    rng = np.random.default_rng(4)
    items = [(int(rng.integers(1, 60)), None if rng.random() < none else f"s{int(rng.integers(sources))}", int(rng.integers(0, 400))) for _ in range(4000)]
    alone = [(size, (i, None) if source is None else source, cluster) for i, (size, source, cluster) in enumerate(items)]
    assert packing.best_fit(*zip(*items), 100) == plain_best_fit(alone, 100)


def test_packing(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = packing.pack_documents(docs, 512).toPandas()
    assert got.groupby("bin")["size"].sum().max() <= 512 and sorted(got.bin.unique()) == list(range(got.bin.nunique()))
    assert not got.duplicated(["bin", "source"]).any() and not got.dropna(subset="cluster").duplicated(["bin", "cluster"]).any()
    placed = got.sort_values(["bin", "offset"])
    assert (placed.groupby("bin")["size"].cumsum() - placed["size"] == placed.offset).all()
    words = {r["doc_id"]: len((r["text"] or "").split()) + 1 for r in docs.collect()}
    assert got.groupby("doc_id")["size"].sum().to_dict() == words
    few = packing.pack_documents(odd).toPandas()
    assert few[few.doc_id == 6]["size"].sum() == 20001 and len(few[few.doc_id.isin([3, 4, 5])]) == 3 and len(few[few.doc_id == 2]) == 2
    assert packing.pack_documents(none).count() == 0


# The pipeline

def test_pipeline_stages(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SMALL).columns == frame.columns, name
    kept = rows(corpus_pipeline.drop_near_duplicates(spark, docs, SMALL), "doc_id")
    assert kept == sorted([(1,), (3,), (4,), (5,), (6,), (8,), (None,)], key=str)
    personal = spark.createDataFrame([(1, "mail x.y@mail1.example.com", "en", "a", 26)], DOCS)
    out = corpus_pipeline.replace_personal_data(spark, personal, SMALL).first()
    assert "x.y@" not in out["text"] and out["n_chars"] == len(out["text"])


def test_pipeline_keeps_what_is_clean(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    toxic = labels.join(docs, "doc_id").select("doc_id", "toxic").toPandas().set_index("doc_id").toxic
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert np.mean([k in left for k in toxic.index[toxic == 0]]) > 0.97 and np.mean([k in left for k in toxic.index[toxic == 1]]) < 0.3
    want = plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert rows(corpus_pipeline.drop_near_duplicates(spark, docs, sf), "doc_id") == sorted([(k,) for k, (_, c) in want.items() if k == c], key=str)
