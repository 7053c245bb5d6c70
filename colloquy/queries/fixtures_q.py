"""The fixture views themselves, so that both spellings are known to agree."""

from colloquy import fixtures as fx
from colloquy.registry import query
from colloquy.fixtures import sql

for _view in ("segments", "invented", "doubled", "words", "turns", "entries", "prose", "heard", "voices",
              "answers"):
    query(f"view_{_view}", sql(_view, f"select * from {_view}"))(
        lambda spark, sf, v=_view: getattr(fx, v)(spark, sf))

query("view_frames", sql("frames", "select recording_id, frame_no, sample from frames"))(
    lambda spark, sf: fx.frames(spark, sf).select("recording_id", "frame_no", "sample"))
