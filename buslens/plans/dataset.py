"""From logs and a catalog to one accounted, decoded dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from buslens.functions.labels import signal_label
from buslens.operators.catalog import Catalog
from buslens.operators.decode import AMBIGUOUS, ERROR, Decoded, decode, decode_diagnostics, message_summary
from buslens.operators.frames import distinct_channels, signal_catalog
from buslens.schema import IDENTITY_COLS, ISSUE_COLS
from buslens.sources.dbc import load_dbc
from buslens.sources.provenance import file_digests
from buslens.sources.readers import read_log

STRICT, PARTIAL = "Strict", "Partial"
VERSION = "1.0.0"


class IntegrityError(ValueError):
    """A strict load met rows it would have to leave out. issues holds them."""

    def __init__(self, message: str, issues: DataFrame):
        super().__init__(message)
        self.issues = issues


@dataclass(frozen=True)
class Dataset:
    frames: DataFrame
    samples: DataFrame
    decoded_frames: DataFrame
    catalog: Catalog
    report: DataFrame
    issues: DataFrame
    digests: DataFrame
    completeness: str
    mode: str


def union_issues(*parts: DataFrame) -> DataFrame:
    """All issues, duplicates kept."""
    out = parts[0].select(*ISSUE_COLS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ISSUE_COLS))
    return out


def decode_issues(decoded_frames: DataFrame) -> DataFrame:
    """One issue per kind of frame that could not be decoded. Unmatched frames are none."""
    code = F.when(F.col("decode_status") == ERROR, "DECODE_ERROR").when(F.col("decode_status") == AMBIGUOUS, "AMBIGUOUS_J1939")
    counts = decoded_frames.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n")).where("code is not null")
    return counts.select(
        F.lit(None).cast("string").alias("source_file"), F.lit("Error").alias("severity"), "code", F.lit("decoder").alias("parser"),
        F.lit(-1).cast("long").alias("source_line"), F.format_string("%d frame(s) were not decoded", "n").alias("message"),
        F.lit("").alias("line_text"))


def integrity_gate(issues: DataFrame, mode: str, what: str) -> bool:
    """Whether there are errors; a strict load stops on them. The only action of a load besides its size checks."""
    if mode not in (STRICT, PARTIAL):
        raise ValueError(f"unknown import mode {mode!r}")
    errors = issues.where(F.col("severity") == "Error").agg(F.count(F.lit(1))).first()[0]
    if errors and mode == STRICT:
        raise IntegrityError(f"{what}: {errors} error(s)", issues)
    return errors > 0


def with_quality(samples: DataFrame, completeness: str) -> DataFrame:
    """In a partial dataset every sample is marked as such."""
    return samples.withColumn("quality", F.lit("PartialDataset")) if completeness == "Partial" else samples


def load_dataset(spark, log_path, dbc_path, *, mode: str = STRICT, fmt: str | None = None) -> Dataset:
    """Read, decode and account for logs. Frames and samples stay lazy."""
    log = read_log(spark, log_path, fmt)
    if not log.frames.take(1):
        raise ValueError("log holds no valid frames")
    partial = integrity_gate(log.issues, mode, "log lines were rejected")
    catalog = load_dbc(spark, dbc_path)
    integrity_gate(catalog.issues, mode, "catalog is not valid")
    partial = partial or bool(catalog.issues.take(1))
    decoded: Decoded = decode(log.frames, catalog)
    late = decode_issues(decoded.frames)
    partial = integrity_gate(late, mode, "frames could not be decoded") or partial
    completeness = "Partial" if partial else "Complete"
    digests = file_digests(spark, log_path).withColumn("kind", F.lit("log")).unionByName(
        file_digests(spark, dbc_path).withColumn("kind", F.lit("dbc")))
    return Dataset(log.frames, with_quality(decoded.samples, completeness), decoded.frames, catalog, log.report,
                   union_issues(log.issues, catalog.issues, late), digests, completeness, mode)


def with_provenance(dataset: Dataset, app_version: str = VERSION) -> DataFrame:
    """One row per log file: its digest, the catalog's digest, version, mode and completeness."""
    dbc = dataset.digests.where("kind = 'dbc'").agg(F.min("sha256").alias("dbc_sha256")).withColumn("k", F.lit(1))
    logs = dataset.digests.where("kind = 'log'").select("source_file", F.col("sha256").alias("source_log_sha256"), F.lit(1).alias("k"))
    return logs.join(dbc, "k").drop("k").withColumns({
        "app_version": F.lit(app_version), "import_mode": F.lit(dataset.mode), "completeness": F.lit(dataset.completeness)})


def dataset_overview(dataset: Dataset) -> DataFrame:
    """One row of counts with the channels in use."""
    totals = decode_diagnostics(dataset.decoded_frames, dataset.catalog, dataset.samples)
    identity = [c for c in IDENTITY_COLS if c in dataset.samples.columns]
    parts = [
        signal_catalog(dataset.samples, identity).agg(F.count(F.lit(1)).alias("signals")),
        message_summary(dataset.decoded_frames).agg(F.count(F.lit(1)).alias("messages")),
        dataset.frames.agg(F.count_if("is_extended").alias("extended_frames")),
        distinct_channels(dataset.frames).agg(F.array_sort(F.collect_list("channel")).alias("channels")),
    ]
    out = totals.withColumn("k", F.lit(1))
    for part in parts:
        out = out.join(part.withColumn("k", F.lit(1)), "k")
    return out.drop("k").withColumn("completeness", F.lit(dataset.completeness))


def signal_labels(samples: DataFrame) -> DataFrame:
    """Signals with their label and number of samples, in label order."""
    identity = [c for c in IDENTITY_COLS if c in samples.columns]
    return signal_catalog(samples, identity).withColumn("label", signal_label()).orderBy("label")
