"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from reviewlens.catalog.queries import QUERIES
from reviewlens.catalog.views import Views

HEADLINE = ["trust_rank", "product_evidence", "themes", "dedupe_reviews", "dedupe_audit", "weak_label_dist",
            "category_medians", "template_cards", "parse_cards", "image_loose", "gallery_recommended",
            "class_report", "split_counts", "basic_clean", "vocabulary", "tfidf_weights", "cluster_keywords",
            "lemmatized_text", "elbow", "silhouette", "svm_metrics", "svd_features", "product_images", "kmeans_scan"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("reviewlens-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    views = Views(spark, folder)
    views["lineitem"].count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](views).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
