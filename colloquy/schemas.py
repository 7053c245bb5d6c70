"""Explicit schemas of the tables every operator takes and returns."""

from pyspark.sql import types as T

WORD = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
])

SEGMENTS = T.StructType([
    T.StructField("recording_id", T.StringType(), False),
    T.StructField("seg_no", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("words", T.ArrayType(WORD)),
])

#: One stored segment, times in seconds as the file has them.
STORED_SEGMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("words", T.ArrayType(T.StructType([
        T.StructField("word", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
    ]))),
])

STORED_TRANSCRIPT = T.StructType([
    T.StructField("schema", T.IntegerType()),
    T.StructField("segments", T.ArrayType(STORED_SEGMENT)),
])

METADATA = T.StructType([
    T.StructField("schema", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("source", T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("mode", T.StringType()),
    ])),
    T.StructField("audio", T.StructType([T.StructField("duration", T.DoubleType())])),
    T.StructField("transcription", T.StructType([
        T.StructField("language", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("backend", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("elapsed", T.DoubleType()),
    ])),
    T.StructField("stats", T.StructType([
        T.StructField("words", T.LongType()),
        T.StructField("segments", T.LongType()),
        T.StructField("speakers", T.LongType()),
    ])),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("speaker_names", T.MapType(T.StringType(), T.StringType())),
])

PRESET = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("max_chars_per_line", T.IntegerType()),
    T.StructField("max_lines", T.IntegerType()),
    T.StructField("max_words_per_minute", T.IntegerType()),
    T.StructField("max_words_per_cue", T.IntegerType()),
    T.StructField("max_chars_per_second", T.DoubleType()),
    T.StructField("min_duration_ms", T.LongType()),
    T.StructField("max_duration_ms", T.LongType()),
    T.StructField("min_gap_ms", T.LongType()),
    T.StructField("sync_lead_in_ms", T.LongType()),
    T.StructField("tail_ms", T.StructType([
        T.StructField("min", T.LongType()), T.StructField("max", T.LongType())])),
    T.StructField("gap_chaining", T.StructType([
        T.StructField("snap_below_ms", T.LongType()), T.StructField("snap_to_ms", T.LongType())])),
    T.StructField("segment_by_words", T.StructType([
        T.StructField("min", T.IntegerType()), T.StructField("max", T.IntegerType())])),
])
