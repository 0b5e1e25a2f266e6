"""Per-event product features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillcask.operators.ordered import Limit, numbered, ranked, windowed
from rillcask.operators.rows import recent
from rillcask.operators.skew import find_hot


def product_analytics(
    events: DataFrame, as_of: str, tiebreak: str, hot: Limit = None
) -> DataFrame:
    """Recency rank, previous and rolling revenue, rank in category and time features."""
    product, ts = ["product_id"], "event_timestamp"
    rows = recent(events, ts, as_of, 30).where(F.col("revenue") > 0)
    by_product, by_category = find_hot(rows, product, hot), find_hot(rows, ["category"], hot)
    rows = numbered(
        rows, product, [F.col(ts).desc(), F.col(tiebreak).desc()], "latest_event_rank",
        hot=by_product,
    )
    rows = windowed(rows, product, [ts, tiebreak], {
        "prev_revenue": lambda w: F.lag("revenue", 1).over(w),
        "rolling_7day_revenue": lambda w: F.sum("revenue").over(w.rowsBetween(-6, 0)),
    }, reach=6, hot=by_product)
    rows = ranked(
        rows, ["category"], "revenue", descending=True, rank="revenue_rank_in_category",
        hot=by_category,
    )
    hour = F.hour(ts)
    return rows.withColumns({
        "event_date": F.date_format(ts, "yyyy-MM-dd"),
        "event_hour": hour,
        "day_of_week": F.dayofweek(ts),
        "purchase_revenue": F.when(
            F.col("event_type") == "purchase", F.col("revenue")
        ).otherwise(0),
        "time_category": F.when(hour.between(9, 17), "business_hours").otherwise("off_hours"),
    }).orderBy("product_id", F.col(ts).desc())
