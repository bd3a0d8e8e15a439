"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_COPIES`` repeats
every document so many times under new ids (default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from suite.ingest import raw_entries  # noqa: E402
from suite.places import flat  # noqa: E402
from suite.views import STAMP, places_v, reviews_v, table  # noqa: E402
from vouch.operators.bm25 import top_hits  # noqa: E402
from vouch.operators.exact import mentions_by_name  # noqa: E402
from vouch.operators.queries import query_table  # noqa: E402
from vouch.plans.indexing import index_reviews  # noqa: E402
from vouch.plans.ingest import import_into  # noqa: E402
from vouch.plans.recommend import recommend  # noqa: E402
from vouch.plans.search import search  # noqa: E402
from vouch.session import new_path, session  # noqa: E402
from vouch.sources.tables import TableStore  # noqa: E402


def run(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def phrases(spark, sf: str, count: int) -> list[str]:
    """Two-word phrases of the benchmark items, as a batch of queries."""
    items = table(spark, sf, "benchmark").orderBy("item_id").select("text").collect()
    words = [word for item in items for word in item["text"].split()]
    return [" ".join(words[i : i + 2]) for i in range(0, 2 * count, 2)]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, job):
        start = time.time()
        result = job()
        times[name] = round(time.time() - start, 3)
        return result

    reviews, places = reviews_v(spark, sf).drop("doc_id"), places_v(spark, sf)
    if copies > 1:
        copy = F.explode(F.sequence(F.lit(1), F.lit(copies)))
        reviews = reviews.withColumn("copy", copy).withColumn(
            "review_id", F.concat_ws("-", "review_id", "copy")
        )
    store = TableStore(spark, new_path(spark, "store"), shards=int(cpus))
    entries = raw_entries(spark, sf)
    run(entries.select("seq"))  # starts the executors and writes the raw lines
    timed(
        "import_entries",
        lambda: import_into(
            TableStore(spark, new_path(spark, "store"), shards=int(cpus)), entries, F.lit(STAMP)
        ).collect(),
    )

    def fill():
        store.commit("reviews", reviews)
        store.commit("places", places)

    timed("store_reviews", fill)
    reviews, places = store.read("reviews"), store.read("places")
    index = timed("build_index", lambda: index_reviews(reviews, new_path(spark, "index")))

    one = query_table(spark, [("of the", ["in the"])])
    many = query_table(spark, phrases(spark, sf, 100))
    timed("search_one", lambda: run(search(index, reviews, places, one)))
    timed("search_one_again", lambda: run(search(index, reviews, places, one)))
    timed("top_hits_batch_100", lambda: run(top_hits(index, many, 10)))
    timed("search_batch_100", lambda: run(search(index, reviews, places, many)))
    timed("recommend_one", lambda: run(flat(recommend(reviews, places, index, one))))
    timed("recommend_one_again", lambda: run(flat(recommend(reviews, places, index, one))))
    timed("recommend_batch_100", lambda: run(flat(recommend(reviews, places, index, many))))
    timed("recommend_by_index", lambda: run(flat(recommend(reviews, places, index, many, match="index"))))
    timed("mentions_sql", lambda: run(mentions_by_name(reviews, ["of the", "ofthe"])))
    print(
        json.dumps(
            {
                "metric": "review_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name,
                "copies": copies,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
