"""Scored documents: flows, locations, prediction and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.geo import add_locations
from flowloom.operators.prepare import with_prediction


def rule_predict() -> Column:
    """A fixed rule in place of a trained model, for results that do not depend on training."""
    c = F.col
    alert = ((c("proto") == 6) & (c("total_bpackets") == 0)) | (c("furg_cnt") > 0) | (c("total_fvolume") > 5000)
    return F.when(alert, 1.0).otherwise(0.0)


def scored_flows(flows: DataFrame, ranges: DataFrame, predict: Column | None = None) -> DataFrame:
    """Flows with locations, ``predict`` (the rule unless given) and ``timestamp`` at flow start."""
    return with_prediction(add_locations(flows, ranges), rule_predict() if predict is None else predict,
                           F.timestamp_micros("start_us"))


def document_time(text: Column) -> Column:
    """A document's time field: date and time, date, or epoch milliseconds."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.timestamp_millis(text.try_cast("bigint")))
