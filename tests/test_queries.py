"""Every registered query runs, and equals its SQL where it has one."""

import pytest
from check import connect, digest, duck_rows, spark_rows
from conftest import SMALL

import __spark_entry__ as entry
from colloquy import fixtures

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    cols, got = spark_rows(QUERIES[name](spark, SMALL))
    if name not in ORACLES:
        return
    names, want = duck_rows(duck, ORACLES[name])
    assert cols == names
    assert len(got) == len(want)
    assert digest(got) == digest(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_every_stretch_is_matched(spark):
    keys = ["recording_id", "seg_no"]
    got, want = QUERIES["match_voices_open"](spark, SMALL).select(*keys), fixtures.voices(spark, SMALL).select(*keys)
    assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
