"""The same rules on recordings still being made, as Structured Streaming queries.

Every function takes and returns a streaming (or plain) DataFrame; sources, sinks and
triggers are the caller's. Event time is ``ts``; rows later than the watermark are dropped.
Paragraphs, speakers and voices keep several states per recording, which needs the RocksDB
state store: start their streams inside :func:`state_store`, or set it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from colloquy.operators.audio import rms_db
from colloquy.operators.speakers import UNKNOWN_SPEAKER

WATERMARK = "10 minutes"
#: A recording that nothing has come of for so long is over.
FORGET = "1 hour"
#: Verdicts on what a microphone hears.
SILENCE, SOUND, SPEECH = "silence", "sound", "speech"
SILENCE_DB, DYNAMIC_DB, ACTIVE, BAND = -50.0, 6.0, (0.05, 0.95), 0.5
MIN_BLOCKS = 15
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, whatever the session's own store; that is put back at the end."""
    own = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, own)


def live_segments(pieces: DataFrame) -> DataFrame:
    """Segments of each transcribed piece on the recording's own clock.

    ``pieces(recording_id, piece_no, piece_start_ms, started_at, segments ARRAY<STRUCT<text,
    start_ms, end_ms, words>>)``. A time that is not known stays so. A column ``piece_ts`` is kept.
    """
    at, more = F.col("piece_start_ms"), [c for c in ["piece_ts"] if c in pieces.columns]
    e = pieces.select("recording_id", "piece_no", "piece_start_ms", "started_at", *more, F.posexplode("segments").alias("seg_in_piece", "s"))
    words = F.transform("s.words", lambda w: F.struct(w["word"].alias("word"), (w["start_ms"] + at).alias("start_ms"), (w["end_ms"] + at).alias("end_ms")))
    start = F.col("s.start_ms") + at
    ts = F.timestamp_micros(F.unix_micros("started_at") + F.coalesce(start, at) * 1000)
    return e.select("recording_id", "piece_no", "seg_in_piece", F.col("s.text").alias("text"), start.alias("start_ms"),
                    (F.col("s.end_ms") + at).alias("end_ms"), words.alias("words"), ts.alias("ts"), *more)


def live_paragraphs(segments: DataFrame, gap_ms: int = 1200, max_chars: int | None = 600, watermark: str = WATERMARK, forget: str = FORGET) -> DataFrame:
    """The paragraphs of speech as it comes: until a pause of over ``gap_ms``, or until one is full.

    ``segments(recording_id, ts, ts_end, text)``, with ``seg_no`` where times may tie; without ``ts_end`` (or where it is null) a
    segment is a point. A pause lasts from the latest end so far. A paragraph is given once the watermark has passed what ends
    it; the state of a recording is its open paragraph and what came within the watermark's delay.
    """
    rows = _spoken(segments.withWatermark("ts", watermark), F.col("ts"))
    out = _conversation(rows, False, gap_ms, max_chars, forget)
    return out.select("recording_id", "started", "ended", "segments", "text")


def live_coverage(segments: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Segments and words of each minute as it fills."""
    return segments.withWatermark("ts", watermark).groupBy("recording_id", F.window("ts", "1 minute").alias("w")).agg(
        F.count("*").alias("segments"), F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("words")).select(
        "recording_id", F.col("w.start").alias("minute"), "segments", "words")


def signal_activity(blocks: DataFrame, watermark: str = WATERMARK, min_blocks: int = MIN_BLOCKS,
                    window: str = "6 seconds", slide: str = "1 second") -> DataFrame:
    """What the last seconds sound like: silence, sound or speech; null before there is enough.

    ``blocks(recording_id, ts, mean_square, band_ratio)``, about ten a second.
    """
    b = blocks.withColumn("_db", rms_db(F.col("mean_square"))).withWatermark("ts", watermark)
    # A window holds some tens of blocks, which it keeps for the second look; they come in any order, which must not decide a verdict.
    g = b.groupBy("recording_id", F.window("ts", window, slide).alias("w")).agg(
        F.percentile("_db", F.lit(0.9)).alias("level_db"), F.percentile("_db", F.lit(0.2)).alias("floor_db"),
        F.collect_list(F.struct("_db", "band_ratio")).alias("_b"))
    loud = F.filter("_b", lambda x: x["_db"] > F.col("floor_db") + DYNAMIC_DB)
    g = g.withColumn("_loud", loud)
    bands = F.when(F.size("_loud") > 0, F.col("_loud")).otherwise(F.col("_b"))
    g = g.withColumns({"dynamic_db": F.col("level_db") - F.col("floor_db"), "active": F.size("_loud") / F.size("_b"),
                       "band_ratio": F.aggregate(bands, F.lit(0.0), lambda a, x: a + x["band_ratio"]) / F.size(bands)})
    verdict = (F.when(F.size("_b") < min_blocks, None).when(F.col("level_db") < SILENCE_DB, SILENCE)
               .when((F.col("dynamic_db") >= DYNAMIC_DB) & F.col("active").between(*ACTIVE) & (F.round("band_ratio", 9) >= BAND), SPEECH)
               .otherwise(SOUND))
    return g.select("recording_id", F.col("w.end").alias("at"), F.size("_b").alias("blocks"), "level_db", "floor_db", "dynamic_db",
                    "active", "band_ratio", verdict.alias("verdict"))


def live_trail(blocks: DataFrame, watermark: str = WATERMARK, window: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Loudness of the last seconds, renewed every second. ``blocks(recording_id, ts, mean_square)``."""
    return blocks.withWatermark("ts", watermark).groupBy("recording_id", F.window("ts", window, slide).alias("w")).agg(
        F.sqrt(F.avg("mean_square")).alias("rms"), F.count("*").alias("blocks")).select(
        "recording_id", F.col("w.end").alias("at"), F.round("rms", 6).alias("rms"), "blocks")


def live_dedup(segments: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A segment delivered twice is taken once."""
    return segments.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["recording_id", "seg_no"])


def live_assign_speakers(segments: DataFrame, turns: DataFrame, watermark: str = WATERMARK, reach: str = "1 hour") -> DataFrame:
    """The turn each segment overlaps most, with both still arriving; null where none is.

    ``segments(recording_id, seg_no, ts, ts_end)``, ``turns(recording_id, turn, turn_ts,
    turn_ts_end, speaker)``. A turn is remembered for segments that start up to ``reach`` from its start, so
    ``reach`` has to be as long as the longest turn: it is what bounds the state. A segment is
    given when the watermark has passed all turns it could meet. :func:`live_speakers` has no such bound and gives every segment a speaker.
    """
    s = segments.select("recording_id", "seg_no", "ts", "ts_end").withWatermark("ts", watermark)
    t = turns.select(F.col("recording_id").alias("_r"), "turn", "turn_ts", "turn_ts_end", "speaker").withWatermark("turn_ts", watermark)
    near = F.expr(f"turn_ts < ts_end AND turn_ts_end > ts AND turn_ts >= ts - INTERVAL {reach} AND turn_ts <= ts + INTERVAL {reach}")
    met = s.join(t, (F.col("recording_id") == F.col("_r")) & near, "left")
    overlap = F.unix_micros(F.least("ts_end", "turn_ts_end")) - F.unix_micros(F.greatest("ts", "turn_ts"))
    return met.groupBy(F.window("ts", "1 second"), "recording_id", "seg_no").agg(
        F.max_by("speaker", F.struct(F.coalesce(overlap, F.lit(0)), -F.col("turn"))).alias("speaker")).drop("window")


class _Conversation(StatefulProcessor):
    """A recording's segments and turns in the order of their starts, however they arrive.

    Rows wait until the watermark has passed them (a segment: its end, so that all turns that could meet it are there). Then
    each segment gets its speaker, or joins the open paragraph, or both. Kept besides: turns that are not over, the
    speaker before, the first speaker, the open paragraph. All of it goes once nothing has come for ``forget_us``.
    """

    SEGMENT, TURN = 0, 1

    def __init__(self, speakers: bool, joins: bool, gap_us: int, max_chars: int | None, forget_us: int):
        self.speakers, self.joins, self.gap_us, self.max_chars, self.forget_us = speakers, joins, gap_us, max_chars, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "kind int, at long, until long, no long, text string, speaker string")
        self.turns = handle.getListState("turns", "at long, until long, no long, speaker string")
        self.who = handle.getValueState("who", "last string, opening string")
        self.open = handle.getValueState("open", "started long, ended long, latest long, segments long, text string, speaker string")
        self.seen = handle.getValueState("seen", "latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.kind), int(r.at), None if pd.isna(r.until) else int(r.until), int(r.no), r.text, r.speaker) for chunk in rows for r in chunk.itertuples()]
        self.waiting.appendList(new)
        latest = max(max(r[1], r[2] or r[1]) for r in new)
        if self.seen.exists():
            latest = max(latest, self.seen.get()[0])
        self.seen.update((latest,))
        self._wake(min(r[1] for r in new))
        self._wake(latest + self.forget_us)
        return iter(())

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(at_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():      # a timer of a recording that is forgotten
            return
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[0] == self.SEGMENT, r[3]))
        turns = [tuple(r) for r in self.turns.get()]
        last, opening = self.who.get() if self.who.exists() else (None, None)
        part = tuple(self.open.get()) if self.open.exists() else None
        out, left, stopped = [], [], False
        # Turns first: every turn that starts before a segment's end has to be known when the segment is settled.
        for kind, at, until, no, _, speaker in rows:
            if kind == self.TURN and at <= now:
                opening = opening or (speaker if speaker is not None else UNKNOWN_SPEAKER)
                turns += [(at, until, no, speaker)] if until is not None and until > at else []
        for row in rows:
            kind, at, until, no, text, speaker = row
            if kind == self.TURN:
                left += [row] if at > now else []
                continue
            stopped = stopped or max(at, until if until is not None and self.speakers else at) > now
            # What comes before the first turn waits for it.
            if stopped or (self.speakers and last is None and opening is None and at + self.forget_us > now):
                stopped = True
                left.append(row)
                continue
            if self.speakers:
                best = 0
                meets = [(min(until, t[1]) - max(at, t[0]), -t[2], t[3]) for t in turns] if until is not None else []
                best = max((m for m in meets if m[0] > 0), key=lambda m: m[:2], default=None)
                speaker = last = (best[2] if best else None) or last or opening or UNKNOWN_SPEAKER
            if self.joins:
                part = self._join(part, at, until, text, speaker, out)
            else:
                out.append((no, at, until, 1, text, speaker))
        earliest = min([r[1] for r in left], default=now)
        if part and earliest - part[2] > self.gap_us and now - part[2] > self.gap_us:
            part = self._close(part, out)
        self._keep(key, left, [t for t in turns if t[1] > min(now, earliest)], (last, opening), part, now)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["recording_id", "no", "started", "ended", "segments", "text", "speaker"])

    def _join(self, part, at, until, text, speaker, out):
        end, text = max(at, until if until is not None else at), (text or "").strip(" ")
        if part and at - part[2] > self.gap_us:
            part = self._close(part, out)
        latest = max(end, part[2]) if part else end
        if not text:
            return (part[0], part[1], latest, *part[3:]) if part else (at, end, latest, 0, "", speaker)
        if part and part[3] and self.max_chars is not None and len(part[4]) >= self.max_chars:
            self._close(part, out)
            part = None
        if part and part[3]:
            return part[0], max(part[1], end), latest, part[3] + 1, f"{part[4]} {text}", part[5]
        return at, end, latest, 1, text, speaker

    def _close(self, part, out):
        if part[3]:
            out.append((0, part[0], part[1], part[3], part[4], part[5]))
        return None

    def _keep(self, key, left, turns, who, part, now) -> None:
        if not left and not part and self.seen.get()[0] + self.forget_us < now:
            for state in (self.waiting, self.turns, self.who, self.open, self.seen):
                state.clear()
            return
        for state, rows in ((self.waiting, left), (self.turns, turns)):
            if rows:
                state.put(rows)
            else:
                state.clear()
        self.who.update(who)
        if part:
            self.open.update(part)
            self._wake(part[2] + self.gap_us)
        else:
            self.open.clear()
        if left:
            nearest = min(max(r[1], r[2] or r[1]) for r in left)
            self._wake(nearest if nearest > now else max(now + 1000, min(r[1] for r in left) + self.forget_us))

    def close(self) -> None:
        pass


def _micros(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def _spoken(segments: DataFrame, start: Column) -> DataFrame:
    """Segments as rows of a conversation; ``ts`` is the event time, which may be earlier than ``start``."""
    def own(name, other):
        return F.col(name) if name in segments.columns else other
    until = F.unix_micros("ts_end") if "ts_end" in segments.columns else F.lit(None).cast("long")
    return segments.select("recording_id", "ts", F.lit(_Conversation.SEGMENT).alias("kind"), F.unix_micros(start).alias("at"), until.alias("until"),
                           own("seg_no", F.lit(0)).cast("long").alias("no"), own("text", F.lit(None)).cast("string").alias("text"), F.lit(None).cast("string").alias("speaker"))


def _conversation(rows: DataFrame, speakers: bool, gap_ms: int, max_chars: int | None, forget: str, joins: bool = True) -> DataFrame:
    kind = rows.schema["recording_id"].dataType.simpleString()
    out = rows.where("at is not null").groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=_Conversation(speakers, joins, gap_ms * 1000, max_chars, _micros(forget)),
        outputStructType=f"recording_id {kind}, no long, started long, ended long, segments long, text string, speaker string",
        outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def _turns(turns: DataFrame, watermark: str) -> DataFrame:
    t = turns.select("recording_id", F.col("turn_ts").alias("ts"), "turn", "turn_ts_end", "speaker").withWatermark("ts", watermark)
    return t.select("recording_id", "ts", F.lit(_Conversation.TURN).alias("kind"), F.unix_micros("ts").alias("at"), F.unix_micros("turn_ts_end").alias("until"),
                    F.col("turn").cast("long").alias("no"), F.lit(None).cast("string").alias("text"), "speaker")


def live_speakers(segments: DataFrame, turns: DataFrame, watermark: str = WATERMARK, forget: str = FORGET) -> DataFrame:
    """``recording_id, seg_no, speaker`` by the rule of the stored segments: the turn overlapped most, else the speaker before, else the first turn's.

    ``segments(recording_id, seg_no, ts, ts_end)``, ``turns(recording_id, turn, turn_ts, turn_ts_end, speaker)``; both may be late by the
    watermark's delay. A turn is kept until it is over, however long it lasts. A segment is given once the watermark has passed
    its end; before the first turn it waits for that, up to ``forget``, after which a silent recording is forgotten as well.
    """
    out = _conversation(_spoken(segments.withWatermark("ts", watermark), F.col("ts")).unionByName(_turns(turns, watermark)), True, 0, None, forget, joins=False)
    return out.select("recording_id", F.col("no").alias("seg_no"), "speaker")


def live_job(pieces: DataFrame, turns: DataFrame, gap_ms: int = 1200, max_chars: int = 600, watermark: str = WATERMARK, forget: str = FORGET) -> DataFrame:
    """A recording while it is made: pieces as they are transcribed and turns as they are told apart, to paragraphs with who opens each.

    Pieces (see :func:`live_segments`) become segments on the recording's clock, a piece delivered twice is taken once,
    segments get their speakers and are joined to paragraphs: three streams' worth of rules in one query with one
    watermark per source and two stateful operators. ``recording_id, started, ended, segments, speaker, text``.
    """
    begins = F.timestamp_micros(F.unix_micros("started_at") + F.col("piece_start_ms") * 1000)
    once = pieces.withColumn("piece_ts", begins).withWatermark("piece_ts", watermark).dropDuplicatesWithinWatermark(["recording_id", "piece_no"])
    s = live_segments(once)
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("end_ms") - F.col("start_ms")) * 1000)
    s = s.select("recording_id", F.col("piece_ts").alias("ts"), F.col("ts").alias("begins"), end.alias("ts_end"), "text",
                 (F.col("piece_no").cast("long") * 1_000_000 + F.col("seg_in_piece")).alias("seg_no"))
    out = _conversation(_spoken(s, F.col("begins")).unionByName(_turns(turns, watermark)), True, gap_ms, max_chars, forget)
    return out.select("recording_id", "started", "ended", "segments", "speaker", "text")


class _Voices(StatefulProcessor):
    """Sums of each recording's voices, and who spoke last; all of it goes once the watermark is ``forget_us`` past the latest stretch."""

    def __init__(self, same: float, fixed: bool, forget_us: int | None = None):
        self.same, self.fixed, self.forget_us = same, fixed, forget_us

    def init(self, handle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")
        self.sums = handle.getMapState("voices", "speaker string", "total array<double>")
        self.last = handle.getValueState("last", "speaker string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._forget(timerValues)
        voices = {k[0]: np.array(v[0]) for k, v in self.sums.iterator()}
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        came = pd.concat(list(rows)).sort_values("seg_no")
        if self.forget_us is not None:
            until = max(int(came["at"].max()) + self.forget_us, self.until.get()[0] if self.until.exists() else 0)
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        for r in came.itertuples():
            vector = None if r.vector is None else np.asarray(r.vector, dtype=float)
            norm = 0.0 if vector is None else float(np.linalg.norm(vector))
            if r.learned is not None and norm:
                who = r.learned
                voices[who] = voices.get(who, 0) + vector / norm
            elif norm and np.isfinite(norm):
                unit = vector / norm
                like = {w: float(unit @ total) / float(np.linalg.norm(total)) for w, total in voices.items()}
                who = max(like, key=like.get) if like else None
                if who is None or (like[who] < self.same and not self.fixed):
                    who = next(name for n in count(len(voices)) if (name := f"SPEAKER_{n:02d}") not in voices)
                voices[who] = voices.get(who, 0) + unit
            else:
                who = last or next(iter(voices), "SPEAKER_00")
            last = who
            out.append((key[0], r.seg_no, who))
        for who, total in voices.items():
            self.sums.updateValue((who,), (total.tolist(),))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["recording_id", "seg_no", "speaker"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget(timerValues)
        return iter(())

    def _forget(self, timerValues) -> None:
        if self.forget_us is not None and self.until.exists() and self.until.get()[0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            for state in (self.sums, self.last, self.until):
                state.clear()

    def close(self) -> None:
        pass


def live_voices(stretches: DataFrame, same: float = 0.5, fixed: bool = False, watermark: str = WATERMARK, forget: str = FORGET) -> DataFrame:
    """Each stretch the voice nearest so far, every voice growing by what it is given.

    ``stretches(recording_id, seg_no, vector, learned)``: ``learned`` names the speaker where a
    turn already did. State per recording is one vector per voice. With event times ``ts``, a recording is forgotten once
    the watermark is ``forget`` past its latest stretch; without them its voices stay. Needs the RocksDB state store.
    """
    out = T.StructType([stretches.schema["recording_id"], T.StructField("seg_no", T.LongType()), T.StructField("speaker", T.StringType())])
    timed = "ts" in stretches.columns
    rows = stretches.withColumn("at", F.unix_micros("ts")).withWatermark("ts", watermark) if timed else stretches
    return rows.groupBy("recording_id").transformWithStateInPandas(
        statefulProcessor=_Voices(same, fixed, _micros(forget) if timed else None), outputStructType=out, outputMode="Append",
        timeMode="EventTime" if timed else "None")
