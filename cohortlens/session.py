"""Session construction and the runtime settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Files and shuffled rows are compressed, and a raw post's text grows several times over behind its last shuffle: 16 MB
# of files gave sorts of 480 to 660 MB a task (``window_shards`` over 10 and 30 times sf0.1, six cores).
TARGET_PARTITION_BYTES = 16 * 1024 * 1024

# Runtime SQL settings: adaptive execution re-plans joins and partition counts from the
# real shuffle sizes; small partitions are coalesced, skewed join partitions split. The
# per-post join feeds an aggregation keyed by the join key, so splitting a skewed
# partition needs one extra shuffle of partial aggregates: "force" allows that.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{TARGET_PARTITION_BYTES}b",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def shuffle_partitions_for(input_bytes: int, cores: int, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Initial shuffle partition count for an input of ``input_bytes``: about one
    partition per ``target_bytes`` (so a partition fits in task memory without
    spilling), never fewer than the cores. AQE coalesces what turns out smaller."""
    return max(cores, -(-int(input_bytes) // target_bytes))


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Total size of the files under ``paths`` (folders, files or wildcards): from the file
    listing alone, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return int(files.agg({"length": "sum"}).first()[0] or 0)


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Apply the adaptive settings; with ``input_bytes`` (size of the raw input) also
    size the initial shuffle partitions to it."""
    for k, v in ADAPTIVE.items():
        spark.conf.set(k, v)
    if input_bytes is not None:
        try:
            cores = spark.sparkContext.defaultParallelism
        except Exception:  # Spark Connect: no context on the client
            cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = str(shuffle_partitions_for(input_bytes, cores))
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "cohortlens",
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in {**ADAPTIVE, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
