"""Packet, Layer-2 and labelled-flow sources, schema migration and JSON columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.fixed_values import CSV_ID_COLUMNS, CSV_LABEL_NAMES
from wirelens.schemas import L2_EVENTS, PACKETS

CAPTURED_PROTOCOLS = ("TCP", "UDP", "ICMP")


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, streaming: bool,
          options: Mapping[str, str]) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(schema).options(**options).load(path)


def read_packets(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet",
                 protocols: Sequence[str] | None = CAPTURED_PROTOCOLS, **options: str) -> DataFrame:
    """A1: packet records; the protocol filter reaches the scan. ``protocols=None`` keeps all."""
    df = _read(spark, path, PACKETS, fmt, streaming, options)
    return capture_filter(df, protocols)


def capture_filter(df: DataFrame, protocols: Sequence[str] | None = CAPTURED_PROTOCOLS
                   ) -> DataFrame:
    return df if protocols is None else df.filter(F.col("protocol").isin(*protocols))


def read_l2_events(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "parquet",
                   **options: str) -> DataFrame:
    """A3: normalised Layer-2 events; absent fields are null."""
    return _read(spark, path, L2_EVENTS, fmt, streaming, options)


def ensure_columns(df: DataFrame, spec: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add each missing column as ``name: (type, default)``; present ones stay untouched."""
    missing = {n: F.lit(d).cast(t) for n, (t, d) in spec.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def parse_json_col(df: DataFrame, column: str, schema: str | T.DataType, out: str) -> DataFrame:
    """A10: replace JSON text by a parsed column; empty or malformed text gives an empty value."""
    empty = F.from_json(F.lit("{}"), schema)
    text = F.when(F.col(column) != "", F.col(column))
    parsed = F.coalesce(F.from_json(text, schema, {"mode": "PERMISSIVE"}), empty)
    return df.withColumn(out, parsed).drop(*([column] if column != out else []))


def load_labelled_flows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow CSV -> numeric feature columns plus ``label``, rows with gaps dropped."""
    raw = spark.read.csv(path, header=True, inferSchema=True,
                         ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return clean_labelled_flows(raw)


def clean_labelled_flows(raw: DataFrame) -> DataFrame:
    df = raw.toDF(*[c.strip() for c in raw.columns])
    label = next((c for c in CSV_LABEL_NAMES if c in df.columns), None)
    if label is None:
        label = next((c for c in df.columns if "label" in c.lower()), None)
    if label is None:
        raise ValueError("no label column")
    fractional = {f.name for f in df.schema.fields
                  if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    finite = [
        F.when(~F.col(f"`{c}`").isin(float("inf"), float("-inf"), float("nan")), F.col(f"`{c}`"))
        .alias(c) if c in fractional else F.col(f"`{c}`") for c in df.columns]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
               and f.name != label and f.name not in CSV_ID_COLUMNS]
    return df.select(finite).na.drop("any").select(
        *[F.col(f"`{c}`") for c in numeric], F.col(f"`{label}`").cast("string").alias("label"))
