"""Features of nested events: arrays, structs, maps, JSON and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.functions.nested import item, map_value, sorted_keys, values_by_key
from rillcask.functions.strings import json_field
from rillcask.operators.ordered import Limit, last_values, seen_so_far
from rillcask.operators.rows import recent
from rillcask.operators.skew import find_hot


def event_processing(
    events: DataFrame, as_of: str, tiebreak: str = "event_id", hot: Limit = None
) -> DataFrame:
    """Last day's events with flattened properties and the user's recent history.

    The country set is sorted, since a set has no order of its own.
    """
    rows = recent(events, "event_timestamp", as_of, 1).where(
        "event_properties is not null and event_metadata is not null"
    )
    tags, fields = F.col("event_properties.tags"), F.col("event_properties.custom_fields")
    country, raw = F.col("event_metadata.location.country"), F.col("raw_event_data")
    flat = rows.select(
        "event_id", "user_id", "event_timestamp", "event_type",
        F.size(tags).alias("tag_count"),
        F.array_contains(tags, "premium").alias("has_premium_tag"),
        tags.alias("all_tags"),
        item(tags, 0).alias("first_tag"),
        F.col("event_metadata.device_info.os").alias("device_os"),
        F.col("event_metadata.device_info.browser").alias("device_browser"),
        country.alias("user_country"),
        F.col("event_metadata.location.city").alias("user_city"),
        map_value(fields, "campaign_id").alias("campaign_id"),
        map_value(fields, "source").alias("traffic_source"),
        sorted_keys(fields).alias("custom_field_keys"),
        values_by_key(fields).alias("custom_field_values"),
        json_field(raw, "$.user.preferences.language").alias("user_language"),
        json_field(raw, "$.session.duration").alias("session_duration"),
        F.concat_ws(",", tags).alias("tags_concatenated"),
        F.array_join(tags, "|").alias("tags_pipe_separated"),
        F.when(F.array_contains(tags, "vip"), country).otherwise("unknown").alias(
            "vip_user_country"
        ),
    )
    order = ["event_timestamp", tiebreak]
    hot = find_hot(rows, ["user_id"], hot)
    flat = last_values(
        flat, ["user_id"], order, 4, "event_type", "recent_event_types", hot
    )
    flat = seen_so_far(
        flat, ["user_id"], order, "user_country", "all_user_countries", hot
    )
    return flat.orderBy("user_id", "event_timestamp")
