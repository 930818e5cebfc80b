"""Session logs: concatenated zstd frames of JSON lines; result and QA files."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed bytes that are decoded at a time.
PIECE = 1 << 20
SESSION_EVENT = (
    "type STRING, seq LONG, time TIMESTAMP, data STRUCT<turn: INT, source: STRUCT<kind: STRING, plugin: STRING>, "
    "content: ARRAY<STRUCT<type: STRING, text: STRING>>, message: STRUCT<content: ARRAY<STRUCT<type: STRING, text: STRING>>>, reason: STRUCT<kind: STRING>>"
)
QA = "questions ARRAY<STRING>, answers ARRAY<ARRAY<STRING>>, context STRING, metadata STRUCT<source: STRING, question_ids: ARRAY<STRING>, question_types: ARRAY<STRING>>"


def frames_of(blob: bytes) -> Iterator[bytes]:
    """Contents of the complete frames, in pieces; a torn last frame gives nothing."""
    import zstandard

    data = memoryview(blob)
    while data:
        frame = zstandard.ZstdDecompressor().decompressobj()
        pieces, at = [], 0
        try:
            while at < len(data) and not frame.eof:
                pieces.append(frame.decompress(data[at : at + PIECE]))
                at = min(at + PIECE, len(data))
        except zstandard.ZstdError:
            return
        if not frame.eof:
            return
        yield from pieces
        data = data[at - len(frame.unused_data) :]


def whole_lines(blob: bytes) -> Iterator[str]:
    """Lines of all complete frames that aren't blank, one frame in memory at a time."""
    rest = b""
    for piece in frames_of(blob):
        *lines, rest = (rest + piece).split(b"\n")
        yield from (t for x in lines if (t := x.decode("utf-8", "replace")).strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


def read_zstd_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of zstd files; one task a file, decoded in batches."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines, at = whole_lines(blob), 0
                while part := list(itertools.islice(lines, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part)], names=["path", "line_no", "value"])
                    at += len(part)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decoded, "path string, line_no long, value string")


def session_events(lines: DataFrame) -> DataFrame:
    return lines.select("path", F.from_json("value", SESSION_EVENT).alias("e")).select("path", "e.*").where("type IS NOT NULL")


def read_results(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of the data[] list of result files."""
    return spark.read.schema(f"data ARRAY<STRUCT<{row}>>").json(path, multiLine=True).select(F.explode("data").alias("d")).select("d.*")


def unzipped(entries: DataFrame, source: str) -> DataFrame:
    """One row a question of the entries of a source; entries whose lists differ in
    length are skipped."""
    ids = F.col("metadata.question_ids")
    same = (F.size("questions") == F.size("answers")) & (F.size("questions") == F.size(ids))
    kept = entries.where((F.col("metadata.source") == source) & same)
    return kept.select(F.explode(F.arrays_zip("questions", "answers", ids.alias("ids"), F.col("metadata.question_types").alias("types"))).alias("z")).select(F.col("z.questions").alias("question"), F.col("z.answers").alias("answers"), F.col("z.ids").alias("question_id"), F.col("z.types").alias("question_type"))


def joined_lines(rows: DataFrame, keys: list[str], order: str, line: Column, name: str = "text") -> DataFrame:
    """Lines of each group joined by newlines, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))), lambda s: s["line"])
    return rows.groupBy(*keys).agg(F.array_join(listed, "\n").alias(name), F.count("*").alias("lines"))


def turn_text(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Labelled lines of each ended turn: what the user (or a goal or schedule) said
    since the turn's start, and what the assistant answered in that turn."""
    from pyspark.sql import Window

    start = F.max(F.when(F.col("type") == "turn/start", F.col("seq"))).over(Window.partitionBy(session, F.col("data.turn")))
    body = F.coalesce(F.col("data.message.content"), F.col("data.content"))
    said = F.array_join(F.transform(F.filter(body, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    admitted = F.when((F.col("type") == "user/message") & (F.col("data.source.kind").isin("user", "goal") | (F.col("data.source.plugin") == "schedule")), "user").when(F.col("type") == "assistant/message", "assistant")
    marked = events.withColumns({"_start": start, "_who": admitted, "_said": said}).where("_who IS NOT NULL AND _said <> '' AND (_start IS NULL OR seq >= _start)")
    return joined_lines(marked.withColumn("turn", F.col("data.turn")), [session, "turn"], "seq", F.concat("_who", F.lit(": "), "_said"), "turn_text").drop("lines")
