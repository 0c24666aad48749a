"""Saved signal selections, and finding their signals in a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from buslens.functions.labels import signal_label
from buslens.plans.staging import same_keys_join, sized

# Fixed values of the file format.
PRESET_TYPE = "can-log-viewer-layout"
VERSIONS = (1, 2)
REF_COLS = ["channel", "frame_format", "is_extended", "frame_id", "message_name", "signal_name"]
FRAME_FORMATS = {"0": "Classic", "1": "FlexibleDataRate"}

_IDENTITY = T.StructType([
    T.StructField("channel", T.StringType()), T.StructField("frame_format", T.StringType()), T.StructField("extended", T.BooleanType()),
    T.StructField("frame_id", T.LongType()), T.StructField("message", T.StringType()), T.StructField("signal", T.StringType()),
    T.StructField("display_label", T.StringType()),
])
_GROUP = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("signals", T.ArrayType(T.StringType())),
    T.StructField("signal_identities", T.ArrayType(_IDENTITY)), T.StructField("offsets", T.MapType(T.StringType(), T.DoubleType())),
])
PRESET = T.StructType([
    T.StructField("preset_type", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("plot_groups", T.ArrayType(_GROUP)),
])


def load_signal_refs(spark, path) -> DataFrame:
    """One row per saved signal of JSON selection files. An unknown type or version fails the read."""
    files = spark.read.schema(PRESET).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return signal_refs(files.withColumn("preset_file", F.col("_metadata.file_path")))


def signal_refs(presets: DataFrame) -> DataFrame:
    kind = F.coalesce("preset_type", F.lit(PRESET_TYPE))
    version = F.coalesce("version", F.lit(2))
    checked = presets.withColumns({
        "version": F.when(kind != PRESET_TYPE, F.raise_error(F.concat(F.lit("unknown preset type "), kind)).cast("int"))
        .when(~version.isin(*VERSIONS), F.raise_error(F.concat(F.lit("unsupported preset version "), version.cast("string"))).cast("int"))
        .otherwise(version)})
    g = F.col("g")
    rows = checked.select("preset_file", "version", F.posexplode("plot_groups").alias("group_no", "g"))
    by_identity = (F.col("version") >= 2) & (F.size(F.coalesce(g["signal_identities"], F.array().cast(T.ArrayType(_IDENTITY)))) > 0)
    texts = F.transform(g["signals"], lambda s: F.struct(
        F.lit(None).cast(_IDENTITY).alias("identity"), F.regexp_extract(s, r"(?s)^(.*?)(?: \[.*)?$", 1).alias("text"), s.alias("key")))
    # Offsets are stored under the text at the same position.
    exact = F.transform(g["signal_identities"], lambda s, i: F.struct(
        s.alias("identity"), F.lit(None).cast("string").alias("text"), F.get(g["signals"], i).alias("key")))
    rows = rows.select("preset_file", "version", "group_no", g["title"].alias("title"), g["offsets"].alias("offsets"),
                       F.posexplode(F.when(by_identity, exact).otherwise(texts)).alias("ord", "r"))
    r = F.col("r")
    fmt = F.coalesce(*[F.when(r["identity"]["frame_format"] == code, F.lit(name)) for code, name in FRAME_FORMATS.items()],
                     r["identity"]["frame_format"])
    return rows.select(
        "preset_file", "group_no", "ord", "title", r["identity"]["channel"].alias("channel"), fmt.alias("frame_format"),
        r["identity"]["extended"].alias("is_extended"), r["identity"]["frame_id"].alias("frame_id"),
        r["identity"]["message"].alias("message_name"), r["identity"]["signal"].alias("signal_name"), r["text"].alias("legacy_text"),
        F.coalesce(F.try_element_at("offsets", r["key"]), F.lit(0.0)).alias("offset"))


def resolve_refs(refs: DataFrame, catalog: DataFrame, *, strict: bool = True) -> DataFrame:
    """Add matches and the matched identity to every reference.

    catalog has one row per signal. A reference must match exactly one signal; strict
    makes any other number an error, otherwise the row keeps its count and no label.
    """
    named = catalog.withColumn("label", signal_label())
    ids = sized(named.groupBy(*REF_COLS).agg(F.countDistinct("label").alias("matches"), F.min("label").alias("label")))
    text = F.concat("message_name", F.lit("."), "signal_name").alias("legacy_text")
    texts = sized(named.groupBy(text).agg(F.countDistinct("label").alias("matches"), F.min("label").alias("label")))
    exact = same_keys_join(refs.where("legacy_text is null"), ids, REF_COLS, "left")
    legacy = same_keys_join(refs.where("legacy_text is not null"), texts, ["legacy_text"], "left")
    out = exact.unionByName(legacy).withColumn("matches", F.coalesce("matches", F.lit(0)))
    if strict:
        what = F.coalesce("legacy_text", F.concat_ws(".", "message_name", "signal_name"))
        fail = F.raise_error(F.concat(F.lit("signal reference "), what, F.lit(" has "), F.col("matches").cast("string"), F.lit(" matches")))
        return out.withColumn("label", F.when(F.col("matches") == 1, F.col("label")).otherwise(fail.cast("string")))
    return out.withColumn("label", F.when(F.col("matches") == 1, F.col("label")))
