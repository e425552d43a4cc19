"""How the per-post join spreads an author who writes a third of all comments.

    python tools/skew_demo.py [--sf-dir DIR] [--rows-per-task N]

Builds the fixture community with one author taking every third comment, then joins the
posts with the users table plainly and with the salted join, and reports for the heavy
author how many join tasks (shuffle partitions) received its rows and the largest share
one task got, plus whether the user-clock results agree. AQE and automatic broadcast
are switched off for the measurement, so the join is the shuffle join a large table gets.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--rows-per-task", type=int, default=20_000)
    ap.add_argument("--partitions", type=int, default=64)
    args = ap.parse_args()

    from pyspark.sql import functions as F

    from cohortlens.operators.enrich import attach_users
    from cohortlens.operators.facts import in_community
    from cohortlens.plans.community import Community
    from cohortlens.session import build_session
    from cohortlens.sources import fixture

    spark = build_session(shuffle_partitions=args.partitions)
    comments, submissions = fixture.community(spark, args.sf_dir)
    heavy = F.when(F.xxhash64("created_utc", "subreddit") % 3 == 0, F.lit("heavy")).otherwise(F.col("author"))
    comments = comments.withColumn("author", F.when(F.col("author").isNull(), None).otherwise(heavy))

    base = Community(comments, submissions, fixture.FIXTURE, materialize=True).build()
    posts = base.posts
    heavy_rows = in_community(posts).where(F.col("author") == "heavy").count()
    total_rows = in_community(posts).count()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    report = {"sf_dir": args.sf_dir, "posts": total_rows, "heavy_author_posts": heavy_rows}
    for label, skew in (("plain", None), ("salted", {"rows_per_task": args.rows_per_task, "max_hot": 100})):
        joined = attach_users(in_community(posts), base.users, skew)
        t0 = time.perf_counter()
        per_task = joined.where(F.col("author") == "heavy").groupBy(F.spark_partition_id()).count().collect()
        counts = sorted((r["count"] for r in per_task), reverse=True)
        report[label] = {
            "tasks_with_heavy_rows": len(counts),
            "largest_task_rows": counts[0],
            "largest_task_share_of_heavy": round(counts[0] / heavy_rows, 3),
            "seconds": round(time.perf_counter() - t0, 2),
        }
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    plain = Community(comments, submissions, fixture.FIXTURE, skew_safe=False)
    plain.__dict__["posts"] = posts
    plain.__dict__["users"] = base.users
    salted = Community(comments, submissions, fixture.FIXTURE, rows_per_task=args.rows_per_task, max_hot=100)
    salted.__dict__["posts"] = posts
    salted.__dict__["users"] = base.users
    a = sorted(map(tuple, plain.metric("posts_per_user", "user", "cohort", overlap=True).collect()))
    b = sorted(map(tuple, salted.metric("posts_per_user", "user", "cohort", overlap=True).collect()))
    report["results_equal"] = a == b
    print(json.dumps(report))


if __name__ == "__main__":
    main()
