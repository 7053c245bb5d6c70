"""Paragraphs of plain texts are made in their rows."""

from colloquy.operators import layout as lo
from colloquy.operators import terms as tm


def test_paragraphs_stay_in_their_rows(spark):
    texts = ["", "   ", None, "One.", "A. B! C? D… E. F. G.", "Il dott. Rossi parla. " * 11, "no stop at all", "x. " * 10]
    prose = spark.createDataFrame(list(enumerate(texts)), "recording_id long, text string")
    want = lo.paragraphs_from_prose(tm.split_sentences(prose))
    got = lo.paragraphs_of_prose(prose)
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    segments = spark.createDataFrame([(4, 0, "Hello.", 0, 900, "user")], "recording_id long, seg_no long, text string, start_ms long, end_ms long, speaker string")
    blocks = lo.transcript_blocks(segments, got)
    assert {r.recording_id for r in blocks.collect()} == {3, 4, 5, 6, 7}
    # Texts are not shuffled.
    assert "Exchange hashpartitioning" not in blocks._jdf.queryExecution().executedPlan().toString()
