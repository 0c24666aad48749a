"""Text logs as numbered lines, and the accounting every log format shares.

Each physical line ends up as exactly one of: non-data, accepted, rejected.
One scan parses the lines, counts them within their split, and writes both: everything
after it reads that table, so numbers do not depend on how a later scan would cut the
files. Counts per split are summed up per file, and the small table of offsets is joined
back. The lines themselves are never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from buslens.functions.time import NANOS_PER_DAY, trimmed
from buslens.plans.staging import same_keys_join, sized, staged
from buslens.schema import FRAME_COLS, ISSUE_COLS

SPLIT = ["source_file", "split_start"]
NON_DATA, ACCEPTED, REJECTED = "non_data", "accepted", "rejected"


@dataclass(frozen=True)
class ParsedLog:
    """Frames with the issue list and the line account of their files."""

    frames: DataFrame
    issues: DataFrame
    report: DataFrame


@dataclass(frozen=True)
class LogFormat:
    """One text format: a function from the trimmed line to the columns below.

    line_class, reject_code, reject_reason, time_ok, raw_ns and the frame fields.
    rebase: times count from the first line of the file whose time parses.
    """

    name: str
    columns: Callable[[DataFrame], DataFrame]
    rebase: bool


def scan_lines(spark: SparkSession, path) -> DataFrame:
    """One row per physical line: file, split, text."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("value").alias("line_text"),
        trimmed(F.col("value")).alias("line"),
    )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's place in its split, the numbered lines before it there, and how the clock ran up to it. A task reads its splits one
    after the other, each in line order."""
    split, seq, fseq, prev, days = None, 0, 0, None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, starts = batch.column("source_file"), batch.column("split_start").to_numpy(zero_copy_only=False)
        codes = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(n, dtype=bool)
        new[1:] = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
        counted = batch.column("counted").to_numpy(zero_copy_only=False).astype("int64")
        readable = batch.column("time_ok").to_numpy(zero_copy_only=False).astype(bool)
        clock = batch.column("raw_ns").fill_null(0).to_numpy(zero_copy_only=False)
        seqs, fseqs, days_at = (np.zeros(n, dtype="int64") for _ in range(3))
        before = np.full(n, -1, dtype="int64")
        for s, e in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], n]):
            if (here := (files[s].as_py(), starts[s])) != split:
                split, seq, fseq, prev, days = here, 0, 0, None, 0
            seqs[s:e] = np.arange(seq, seq + e - s)
            fseqs[s:e] = fseq + np.cumsum(counted[s:e]) - counted[s:e]
            seq, fseq = seq + e - s, fseq + int(counted[s:e].sum())
            at = s + np.flatnonzero(readable[s:e])
            if len(at):
                earlier = np.concatenate([[-1 if prev is None else prev], clock[at[:-1]]])
                drops = (earlier >= 0) & (earlier - clock[at] > NANOS_PER_DAY // 2)
                before[at] = earlier
                days_at[at] = days + np.cumsum(drops)
                prev, days = int(clock[at[-1]]), int(days_at[at[-1]])
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (seqs, fseqs, days_at)), pa.array(before, mask=before < 0)],
                                         names=[*batch.schema.names, "seq", "fseq", "days", "prev_ns"])


def stage_lines(rows: DataFrame, *, counted: Column | None = None, texts: Column | None = None) -> DataFrame:
    """The parsed lines as a written table with seq, fseq, days and prev_ns (see _positions).

    counted: the lines that fseq counts, accepted ones by default. texts: lines whose text is kept, rejected ones by default.
    """
    cls = F.col("line_class")
    rows = rows.withColumns({"counted": F.coalesce(counted if counted is not None else cls == ACCEPTED, F.lit(False)),
                             "time_ok": F.coalesce("time_ok", F.lit(False)),
                             "line_text": F.when(texts if texts is not None else cls == REJECTED, F.col("line_text"))})
    kept = [c for c in [*SPLIT, "line_text", "line_class", "reject_code", "reject_reason", "time_ok", "raw_ns", "counted", "is_header", *FRAME_COLS]
            if c in rows.columns]
    rows = rows.select(*dict.fromkeys(kept))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("seq", "fseq", "days", "prev_ns")]])
    return staged(rows.mapInArrow(_positions, schema), "lines")


def lines_of(parsed: DataFrame, line_class: str) -> DataFrame:
    return parsed.where(F.col("line_class") == line_class)


_CUT = "\u0001"


def groups(line: Column, pattern: str, n: int) -> Column:
    """The n capture groups of a whole-line pattern as an array, from one regex pass; NULL if no match."""
    joined = F.regexp_replace(line, pattern, _CUT.join(f"${i}" for i in range(1, n + 1)))
    return F.when(~line.contains(_CUT) & joined.contains(_CUT), F.split(joined, _CUT, -1))


def split_table(parsed: DataFrame) -> DataFrame:
    """One staged row per split: its line counts, and what is added to a line's place in its split.

    line_off and frame_off turn seq and fseq into file numbers (see number_frames). base_ns is
    the first readable time of the file, day_off the midnights that passed before the split.
    """
    cls, at = F.col("line_class"), F.when(F.col("time_ok"), F.col("seq"))
    per_split = parsed.groupBy(*SPLIT).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("counted").alias("frames"), F.count_if(cls == NON_DATA).alias("non_data"),
        F.count_if(cls == ACCEPTED).alias("accepted"), F.count_if(cls == REJECTED).alias("rejected"),
        F.min_by("raw_ns", at).alias("base"), F.max_by("raw_ns", at).alias("last"), F.max("days").alias("days"))
    in_file = Window.partitionBy("source_file").orderBy("split_start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole_file = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    last_before = F.last("last", ignorenulls=True).over(before)
    rows = per_split.withColumns({"last_ns": last_before,
                                  "night": F.when(last_before - F.col("base") > NANOS_PER_DAY // 2, 1).otherwise(0).cast("long")})
    return sized(rows.select(
        *SPLIT, "total", "non_data", "accepted", "rejected", "last_ns",
        (F.coalesce(F.sum("total").over(before), zero) + 1).alias("line_off"),
        F.coalesce(F.sum("frames").over(before), zero).alias("frame_off"),
        (F.coalesce(F.sum(F.col("days") + F.col("night")).over(before), zero) + F.col("night")).alias("day_off"),
        F.first("base", ignorenulls=True).over(whole_file).alias("base_ns")))


def number_lines(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Add the 1-based physical line number and the file's base time."""
    off = splits.select(*SPLIT, "line_off", "base_ns")
    return same_keys_join(rows, off, SPLIT).withColumn("source_line", F.col("seq") + F.col("line_off")).drop("line_off")


def number_frames(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Add the line number, the 0-based number among the counted lines, the file's base time and the clock's last time before the split."""
    off = splits.select(*SPLIT, "line_off", "frame_off", "base_ns", "last_ns", "day_off")
    return same_keys_join(rows, off, SPLIT).withColumns({
        "source_line": F.col("seq") + F.col("line_off"), "frame_index": F.col("fseq") + F.col("frame_off"),
    }).drop("line_off", "frame_off")


def classify(rows: DataFrame, bad: Column, code: str) -> DataFrame:
    """Give every line its class and every rejected line its code and reason.

    Needs non_data and matched; bad is the reason why a matching line holds no valid frame.
    """
    data, matched = ~F.col("non_data"), F.col("matched")
    return rows.withColumn("bad", bad).withColumns({
        "line_class": F.when(~data, NON_DATA).when(matched & F.col("bad").isNull(), ACCEPTED).otherwise(REJECTED),
        "reject_code": F.when(data & ~matched, f"{code}_SYNTAX").when(data & F.col("bad").isNotNull(), f"{code}_VALUE"),
        "reject_reason": F.when(data & ~matched, f"line has no {code.lower()} layout").when(data, F.col("bad")),
    })


def finish(splits: DataFrame, parsed: DataFrame, fmt: LogFormat, frames: DataFrame, warnings: DataFrame | None = None) -> ParsedLog:
    """Assemble frames, issues and the per-file account."""
    rejected = lines_of(parsed, REJECTED).select(
        *SPLIT, "seq", F.lit("Error").alias("severity"), F.col("reject_code").alias("code"),
        F.col("reject_reason").alias("message"), "line_text")
    if warnings is not None:
        rejected = rejected.unionByName(warnings)
    issues = number_lines(rejected, splits).withColumn("parser", F.lit(fmt.name)).select(*ISSUE_COLS)
    return ParsedLog(frames.select(*FRAME_COLS), issues, line_account(splits, fmt.name))


def line_account(splits: DataFrame, parser: str) -> DataFrame:
    """Per file: total = non_data + accepted + rejected; Partial as soon as a line was rejected."""
    return splits.groupBy("source_file").agg(
        F.lit(parser).alias("parser"), *[F.sum(c).alias(c) for c in ("total", "non_data", "accepted", "rejected")],
    ).withColumn("completeness", F.when(F.col("rejected") > 0, "Partial").otherwise("Complete"))


def read_format(spark: SparkSession, path, fmt: LogFormat) -> ParsedLog:
    """Read files of a format in which every line stands for itself."""
    parsed = stage_lines(fmt.columns(scan_lines(spark, path)))
    splits = split_table(parsed)
    frames = number_frames(lines_of(parsed, ACCEPTED), splits)
    time = F.col("raw_ns") - F.col("base_ns") if fmt.rebase else F.col("raw_ns")
    return finish(splits, parsed, fmt, frames.withColumn("ts_ns", time))


def plain_lines(spark: SparkSession, path) -> DataFrame:
    """Numbered lines without any parsing: source_file, source_line, line_text, line."""
    flat = scan_lines(spark, path).withColumns({"line_class": F.lit(NON_DATA), "time_ok": F.lit(False), "raw_ns": F.lit(0).cast("long")})
    rows = stage_lines(flat, texts=F.lit(True))
    return number_lines(rows, split_table(rows)).select("source_file", "source_line", "line_text", trimmed(F.col("line_text")).alias("line"))
