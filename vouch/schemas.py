"""Fixed schemas of the keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PLACES = T.StructType(
    [
        T.StructField("place_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("review_count", T.IntegerType()),
        T.StructField("maps_url", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
    ]
)

REVIEWS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("place_id", T.StringType()),
        T.StructField("place_name", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("published_date", T.StringType()),
        T.StructField("reviewer_name", T.StringType()),
        T.StructField("owner_response", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
    ]
)

KEYS = {"places": "place_id", "reviews": "review_id"}
SCHEMAS = {"places": PLACES, "reviews": REVIEWS}

# columns that are NULL, not "", when the source lacks them
_NULLABLE = {"rating", "review_count", "owner_response"}


def now_utc() -> Column:
    """Current instant as ISO-8601 text with offset."""
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def conform(df: DataFrame, schema: T.StructType, scraped_at: Column | None = None) -> DataFrame:
    """Project ``df`` onto ``schema``: missing columns get their default, types are cast."""
    columns = []
    for field in schema:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name == "scraped_at":
            value = now_utc() if scraped_at is None else scraped_at
        else:
            value = F.lit(None) if field.name in _NULLABLE else F.lit("")
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
