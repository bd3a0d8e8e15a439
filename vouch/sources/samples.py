"""A small sample of places and reviews to try the queries on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def sample_places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        pa.table(
            {
                "place_id": ["sample_north", "sample_harbour", "sample_mill"],
                "name": ["Northside Keyworks", "Harbour Computer Care", "Old Mill Repairs"],
                "address": ["4 North St", "18 Quay Rd", "2 Mill Ln"],
                "rating": [4.7, 4.1, None],
                "review_count": pa.array([140, 62, None], pa.int32()),
                "maps_url": ["https://maps.example.com/place/" + s for s in "nhm"],
                "category": ["repair"] * 3,
            }
        )
    )


def sample_reviews(spark: SparkSession) -> DataFrame:
    rows = [
        ("sample_north", "They offered keyboard-repair while I waited, keys feel new again.", 5, "2 months ago", "Ana", None),
        ("sample_north", "Their keyboard repair fixed a spill. Best keyboardrepair in town!", 5, "a year ago", "Bo", "Thank you, Bo."),
        ("sample_harbour", "Friendly staff, my screen was replaced in a day.", 4, "3 weeks ago", "Cem", None),
        ("sample_harbour", "Long wait and a high bill for a new battery.", None, "5 months ago", "Dee", None),
        ("sample_mill", "Sadly they don't do keyboard repair, only lamps and clocks.", 2, "6 months ago", "Eli", None),
        ("sample_mill", "Asked about deskboard-fitting of key caps, they did it well.", None, "", "Flo", None),
    ]
    names = {"sample_north": "Northside Keyworks", "sample_harbour": "Harbour Computer Care", "sample_mill": "Old Mill Repairs"}
    column = lambda i, t=None: pa.array([row[i] for row in rows], t)
    return spark.createDataFrame(
        pa.table(
            {
                "review_id": [f"{row[0]}::r{i % 2 + 1}" for i, row in enumerate(rows)],
                "place_id": column(0),
                "place_name": [names[row[0]] for row in rows],
                "text": column(1),
                "rating": column(2, pa.int32()),
                "published_date": column(3),
                "reviewer_name": column(4),
                "owner_response": column(5, pa.string()),
            }
        )
    )
