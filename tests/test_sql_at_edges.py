"""Queries against their SQL on rows the driver tables seldom hold."""

import math
import time
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check import TABLES, connect, digest, duck_rows, spark_rows
from conftest import SMALL

from colloquy.catalog import ORACLES, QUERIES
from colloquy.operators import proofread
from colloquy.operators import terms as tm
from colloquy.sources import readers


@pytest.fixture
def against_sql(spark, tmp_path):
    """``(name, table, columns)``: a query's rows and its SQL's over the small tables with one of them replaced."""
    def compare(name, table, columns):
        folder = tmp_path / uuid.uuid4().hex
        folder.mkdir()
        for t in TABLES:
            (folder / f"{t}.parquet").symlink_to(Path(SMALL) / f"{t}.parquet")
        (folder / f"{table}.parquet").unlink()
        pq.write_table(pa.table(columns).cast(pq.read_schema(f"{SMALL}/{table}.parquet")), folder / f"{table}.parquet")
        cols, got = spark_rows(QUERIES[name](spark, str(folder)))
        names, want = duck_rows(connect(str(folder)), ORACLES[name])
        assert cols == names and digest(got) == digest(want)
        return got
    return compare


def test_a_section_without_keywords_has_no_title(against_sql):
    text = " ".join(["A b."] * 20)
    got = against_sql("label_sections", "conversations", {"conv_id": [1], "turn": [0], "role": ["assistant"], "text": [text]})
    assert any(row[2] == "None" for row in got)


def test_the_capital_of_a_letter_is_one_letter(against_sql):
    text = " ".join(["Eine ßkeit."] * 20)
    got = against_sql("label_sections", "conversations", {"conv_id": [1], "turn": [0], "role": ["assistant"], "text": [text]})
    assert any("ẞkeit" in row[2] for row in got)


@pytest.mark.parametrize("name", ["learn_voices", "learn_all_voices"])
def test_a_sum_just_below_zero_keeps_its_sign(against_sql, name):
    tiny = 1e-7 / math.sqrt(63)
    vectors = [[1.0, -1e-7, *[0.0] * 62], [1.0, 0.0, *[tiny] * 62]]
    got = against_sql(name, "embeddings", {"vec_id": [0, 1], "embedding": vectors, "label": [3, 3]})
    assert "-0.000000" in got[0][3]


def test_sentences_end_where_no_abbreviation_does(spark):
    text = "Il sig. Rossi e la sig.ra Bianchi. Dr. No? Ok!! Vs. them... End etc. dell'ing. Neri.  Not a mr.x. Prof!? yes"
    got = spark.createDataFrame([(1, text)], "recording_id long, text string")
    assert [r.text for r in tm.split_sentences(got).orderBy("sent_no").collect()] == [
        "Il sig. Rossi e la sig.ra Bianchi.", "Dr. No?", "Ok!!", "Vs. them...", "End etc. dell'ing. Neri.", "Not a mr.x.", "Prof!? yes"]


def test_headers_of_a_long_vocabulary_are_read_once(spark):
    """Once a term, these 20,000 terms took about a minute."""
    raw = "# Title: Long\n# language: it\n" + ", ".join(f"term-{i}" for i in range(20_000))
    files = spark.createDataFrame([("long", 0, raw)], "name string, precedence int, raw string").cache()
    files.count()
    start = time.time()
    got = readers.vocabulary_terms(files).agg({"title": "max", "language": "max", "term_no": "max"}).first()
    assert sorted(map(str, got)) == ["19999", "Long", "it"]
    assert time.time() - start < 15


def test_a_prompt_takes_the_terms_of_its_lists_in_order(spark):
    jobs = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "none", "b"]), (3, []), (4, None)], "recording_id long, names array<string>")
    voc = spark.createDataFrame([("a", 1, "a1"), ("a", 0, "a0"), ("b", 0, "b0")], "name string, term_no int, term string")
    words = spark.createDataFrame([(r, n, w) for r in (1, 2, 4) for n, w in enumerate(["Anna", "Berta", "Clara"])], "recording_id long, n long, word string")
    got = {r.recording_id: r.prompt for r in proofread.vocabulary_prompt(jobs, voc, words, room=21).collect()}
    assert got == {1: "b0, a0, a1 Anna Berta", 2: "a0, a1, b0 Anna Berta", 3: "", 4: "Anna Berta Clara"}
