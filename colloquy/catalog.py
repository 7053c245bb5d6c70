"""The registered queries: each operator over the fixture views, with equivalent SQL."""

from colloquy.queries import (catalogue_q, cleaning_q, files_q, fixtures_q, jobs_q, layout_q, notes_q,  # noqa: F401
                              spelling_q, streaming_q, subtitles_q, summary_q)
from colloquy.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
