"""Library entries: what a patch replaces."""

from colloquy.operators import catalogue

SCHEMA = "entry_id string, title string, source struct<filename:string,sha256:string>"


def test_a_given_null_replaces(spark):
    entries = spark.createDataFrame([("a", "A", ("a.wav", "1")), ("b", "B", ("b.wav", "2")), ("c", "C", ("c.wav", "3"))], SCHEMA)
    patches = spark.createDataFrame([("a", None, (None, "9"), ["title"]), ("b", "Bee", (None, None), ["source.filename"]), ("d", "D", None, None)], SCHEMA + ", given array<string>")
    got = {r["entry_id"]: (r["title"], r["source"] and tuple(r["source"])) for r in catalogue.upsert_metadata(entries, patches).collect()}
    assert got == {"a": (None, ("a.wav", "9")), "b": ("Bee", (None, "2")), "c": ("C", ("c.wav", "3")), "d": ("D", None)}
