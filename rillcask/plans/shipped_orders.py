"""Orders matched with their shipments and the lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.functions.times import fmt_ts
from rillcask.operators.joins import interval_join


def shipped_orders(
    orders: DataFrame, shipments: DataFrame, within: str = "7 days", grace: str = "2 seconds"
) -> DataFrame:
    """Inner join of orders (id, order_time) and shipments (shipment_id, order_id,
    ship_time) at most ``within`` apart; whole minutes from order to shipment. The
    same body runs on tables and on streams, where ``grace`` delays the watermarks.
    An order id has few rows, so they are joined by it alone."""
    ships = shipments.withColumnRenamed("order_id", "ship_order_id")
    pairs = interval_join(
        orders, ships, [("id", "ship_order_id")], "order_time", "ship_time",
        within, within, grace, spread=None,
    )
    millis = F.unix_millis(F.col("ship_time").cast("timestamp")) - F.unix_millis(
        F.col("order_time").cast("timestamp")
    )
    pattern = "yyyy-MM-dd HH:mm:ss"
    return pairs.select(
        F.col("id").alias("order_id"), fmt_ts(F.col("order_time"), pattern).alias("order_ts"),
        "total_amount", "customer_name", "shipment_id",
        fmt_ts(F.col("ship_time"), pattern).alias("shipment_ts"), "warehouse",
        (millis / 60000).cast("long").alias("ship_minutes"),
    )
