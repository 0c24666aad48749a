"""Which text format each file has, judged by its first lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buslens.functions.time import trimmed
from buslens.sources.busmaster import BUSMASTER
from buslens.sources.candump import CANDUMP
from buslens.sources.css import is_header
from buslens.sources.files import chunks, first_lines, listed, open_stream, streamed, unpacked
from buslens.sources.lines import scan_lines
from buslens.sources.peak import PEAK_CLASSIC, PEAK_TSV

# Lines looked at, and the points a format gets for them.
PROBE_LINES = 200
#: Bytes of a file that are looked at, where lines are long.
PROBE_BYTES = 4 << 20
PROBE_CHUNK = 1 << 15
FORMATS = ["candump", "busmaster", "peak", "css"]


def detect_format(spark, path, *, stream: bool | None = None) -> DataFrame:
    """One row per file that has lines: four scores, the best format, and a status.

    status is ok, unknown (no format scored) or ambiguous (two formats share the best score). A file is opened and read until its first lines are complete; how long it
    is does not matter. In stores that only Spark's readers reach (stream=False), and for packings that only they know, all of the text is scanned.
    """
    files = listed(spark, path)
    if stream is None:
        stream = streamed(files) and files.where(F.lower("path").rlike(r"\.(zst|lz4|snappy|xz|lzo)$")).isEmpty()
    if stream:
        heads = files.mapInArrow(_file_heads, "source_file string, line_text string")
        return score_heads(heads.withColumn("line", trimmed(F.col("line_text"))))
    lines = scan_lines(spark, path).where("split_start = 0").select("source_file", "line_text", "line")
    return score_heads(lines.mapInArrow(_heads, lines.schema))


def _file_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first lines of each file."""
    for batch in batches:
        for name, path in zip(batch.column("source_file").to_pylist(), batch.column("path").to_pylist()):
            with open_stream(path) as stream:
                lines = first_lines(unpacked(path, chunks(stream, PROBE_CHUNK)), PROBE_LINES, PROBE_BYTES)
            yield pa.RecordBatch.from_pydict({"source_file": pa.array([name] * len(lines), pa.string()), "line_text": pa.array(lines, pa.string())})


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first lines of each file, which its first split holds, in order."""
    file, seen = None, 0
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        codes = batch.column("source_file").dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        for s in np.flatnonzero(np.diff(codes, prepend=-1)):
            e = s + int((codes[s:] == codes[s]).cumprod().sum())
            if names[codes[s]] != file:
                file, seen = names[codes[s]], 0
            keep[s:s + max(0, min(e - s, PROBE_LINES - seen))] = True
            seen += e - s
        yield batch.filter(pa.array(keep))


def score_heads(head: DataFrame) -> DataFrame:
    """Scores from source_file, line_text and the trimmed line."""
    line, text, name = F.col("line"), F.lower("line_text"), F.lower("source_file")
    row_like = (F.length("line_text") - F.length(F.replace("line_text", F.lit(";"))) >= 3) & F.contains("line_text", F.lit("T"))
    counts = head.groupBy("source_file").agg(
        F.count_if(line.rlike(CANDUMP)).alias("n_candump"),
        F.count_if(line.rlike(BUSMASTER)).alias("n_busmaster"),
        F.count_if(line.rlike(PEAK_CLASSIC) | line.rlike(PEAK_TSV)).alias("n_peak"),
        F.max(text.contains("$fileversion") | text.contains("$columns")).alias("peak_sign"),
        F.max(is_header(F.split(line, ";", -1))).alias("css_head"),
        F.count_if(row_like).alias("n_css"),
    )
    scores = counts.select(
        "source_file",
        F.least(F.lit(100), F.col("n_candump") * 20).alias("candump"),
        (F.least(F.lit(90), F.col("n_busmaster") * 15) + F.when(name.endswith(".log"), 10).otherwise(0)).alias("busmaster"),
        F.least(F.lit(100), F.when(F.col("peak_sign"), 30).otherwise(0) + F.when(name.endswith(".trc"), 15).otherwise(0)
                + F.col("n_peak") * 10).alias("peak"),
        F.least(F.lit(100), F.when(F.col("css_head"), 70).otherwise(0) + F.col("n_css") * 5).alias("css"),
    )
    best = F.greatest(*FORMATS)
    ties = sum((F.when(F.col(f) == best, 1).otherwise(0) for f in FORMATS), F.lit(0))
    status = F.when(best <= 0, "unknown").when(ties > 1, "ambiguous").otherwise("ok")
    winner = F.coalesce(*[F.when(F.col(f) == best, F.lit(f)) for f in FORMATS])
    return scores.withColumns({"status": status, "format": F.when(status == "ok", winner)})
