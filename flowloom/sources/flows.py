"""Flow records and the feature dictionary as text files, and the wire format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schema import DICTIONARY_SCHEMA, GEO_SCHEMA, RECORD_FIELDS, WIRE_FIELDS, WIRE_SCHEMA


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow CSV: 45 features and the class.  The schema is fixed, so nothing is inferred."""
    return spark.read.schema(WIRE_SCHEMA).csv(path)


def write_flows(flows: DataFrame, path: str) -> None:
    """Append flow records as CSV lines."""
    flows.select(*[c for c in WIRE_FIELDS if c in flows.columns]).write.mode("append").csv(path)


def read_feature_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Feature index, name and description.  A description may contain commas: all after the second belongs
    to it."""
    line = F.split("value", ",", 3)
    return (spark.read.text(path).filter(F.trim("value") != "")
            .select(F.trim(line[0]).cast("int").alias("idx"), F.trim(line[1]).alias("name"),
                    F.trim(line[2]).alias("description"))
            .to(DICTIONARY_SCHEMA))


def read_geo_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Address ranges with their location, as CSV."""
    return spark.read.schema(GEO_SCHEMA).csv(path)


def _csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in columns])


def encode_wire(flows: DataFrame, label: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Each flow as a message: its CSV line and class, written as a JSON string literal."""
    cls = F.col("class") if label is None else F.lit(label)
    line = _csv_line([*[F.col(c) for c in RECORD_FIELDS], cls])
    escaped = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return flows.select(*keep, F.concat(F.lit('"'), escaped, F.lit('"')).alias("value"))


def _parsed(messages: DataFrame, column: str) -> DataFrame:
    """Each message with its ``flow`` and the ``reason`` why it is no flow record, parsed once."""
    raw = F.col(column).cast("string")
    read = F.from_csv(F.get_json_object(raw, "$"), f"{WIRE_SCHEMA.toDDL()}, _bad string",
                      {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    kept = [c for c in messages.columns if c != column]
    # one pass through an array keeps Spark from writing the parser into every field
    once = messages.select(*kept, raw.alias("raw"), F.inline(F.array(F.struct(
        F.get_json_object(raw, "$").alias("line"), read.alias("flow")))))
    missing = [F.col(f"flow.{f}").isNull() for f in RECORD_FIELDS]
    any_missing = F.array_contains(F.array(*missing), True)
    reason = (F.when(F.col("line").isNull(), "no text in quotes").when(F.col("flow._bad").isNotNull(), "fields")
              .when(any_missing, "empty field").when(F.coalesce(F.col("flow.class"), F.lit("")) == "", "no class"))
    # as a column of its own, the reason brings no conditions on every field into the plans that filter by it
    return once.select(*kept, "raw", F.inline(F.array(F.struct(F.col("flow"), reason.alias("reason")))))


def decode_wire(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages back to typed flow records; the other columns of ``messages`` are kept.

    Messages that are no complete record are left to ``wire_rejects``; no message is in both or in neither.
    """
    kept = [c for c in messages.columns if c != column]
    good = _parsed(messages, column).filter("reason is null")
    return good.select(*kept, *[F.col(f"flow.{n}").alias(n) for n in WIRE_FIELDS])


def wire_rejects(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages that are no complete flow record: the other columns, the ``raw`` message and the ``reason``."""
    kept = [c for c in messages.columns if c != column]
    return _parsed(messages, column).filter("reason is not null").select(*kept, "raw", "reason")
