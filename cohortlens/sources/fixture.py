"""A two-stream community log derived from the driver's order tables.

Every order becomes a submission and every line item a comment; a customer's accounts become
authors. A customer has up to three accounts, used before, during and after a membership
span that is staggered per customer, so every cohort and survival bucket is populated and no
row is left out; a few customers get deleted / bot-like / missing names so the cleaning
rules have work to do. The mapping is a pure projection + two equi-joins, so it scales with
the input tables and keeps parquet pushdown and pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.clocks import epoch_seconds, idiv
from cohortlens.spec import FIXTURE, YEAR_S

ORIGIN = FIXTURE.origin


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out by ``key``, for the side of a join that is streamed.

    The driver's files are single row groups, so a scan is one task whatever its size, and
    all per-row work before the first shuffle would run on one core. Adaptive execution
    sizes the partitions from the rows that arrive.
    """
    return df.repartition(key)


def _author(custkey: Column, account: Column) -> Column:
    n = F.concat_ws("_", custkey.cast("string"), account.cast("string"))
    return (
        F.when(custkey % 97 == 3, F.lit("[deleted]"))
        .when(custkey % 89 == 4, F.concat(F.lit("user_"), n, F.lit("_bot")))
        .when(custkey % 83 == 5, F.concat(F.lit("user_"), n, F.lit("Bot")))
        .when(custkey % 79 == 6, F.concat(F.lit("MyTranscriber"), n))
        .when(custkey % 73 == 7, F.concat(F.lit("AutoModerator"), n))
        .when(custkey % 71 == 8, F.lit(None).cast("string"))
        .when(custkey % 67 == 9, F.concat(F.lit("user_"), n, F.lit("bot")))
        .otherwise(F.concat(F.lit("user_"), n))
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is worked out once a row. Filters on a plain column are pushed below it, with its whole expression in
    the place of its name, once for each mention: here, a time and a name of many steps for every rule on names."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def account_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with author (the customer's account at that time), community and time."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    cust, t = F.col("o_custkey"), F.col("t")
    t_join = F.lit(ORIGIN) + (cust % 7) * YEAR_S
    t_leave = F.lit(ORIGIN) + (cust % 7 + 1 + idiv(cust, 7) % 7) * YEAR_S
    account = F.when(t < t_join, 0).when(t < t_leave, 1).otherwise(2)
    key = F.col("o_orderkey")
    day = idiv(t - F.lit(ORIGIN), 86400)
    timed = once(o, "t", epoch_seconds("o_orderdate"))
    return once(timed, "author", _author(cust, account)).select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        "t",
        "author",
        F.when(key % 211 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("sub_"), idiv(day * (key % 100 + 1), 1000).cast("string")))
        .alias("subreddit"),
    )


def raw_submissions(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """title, selftext, author, created_utc, subreddit — one row per order."""
    key = F.col("o_orderkey")
    orders = account_orders(spark, sf_dir) if orders is None else orders
    return spread(orders, "o_orderkey").select(
        F.col("o_orderpriority").alias("title"),
        F.when(key % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.repeat(F.col("o_orderstatus"), (key % 50).cast("int")))
        .alias("selftext"),
        "author",
        F.when(key % 101 == 0, F.lit(None).cast("long")).otherwise(F.col("t")).alias("created_utc"),
        "subreddit",
    )


def raw_comments(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """body, author, created_utc, subreddit — one row per line item."""
    li = spread(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
        ),
        "l_orderkey",
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    orders = (account_orders(spark, sf_dir) if orders is None else orders).select(
        "o_orderkey", "t", "author", "subreddit"
    )
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.repeat(F.col("p_name"), F.col("l_quantity").cast("int")))
        .alias("body"),
        "author",
        F.when(F.col("l_suppkey") % 101 == 0, F.lit(None).cast("long"))
        .otherwise(F.col("t") + F.col("l_linenumber").cast("long") * 86400)
        .alias("created_utc"),
        "subreddit",
    )


def community(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(raw_comments, raw_submissions) of the fixture community."""
    orders = account_orders(spark, sf_dir)
    return raw_comments(spark, sf_dir, orders), raw_submissions(spark, sf_dir, orders)
