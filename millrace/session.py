"""Session helpers: where scratch data goes, and a builder for local runs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPLIT_KEY = "spark.sql.files.maxPartitionBytes"
SMALL_BYTES = 1 << 30
SPLIT_BYTES = 512 << 20
UNKNOWN_BYTES = 1 << 56  # Spark's stand-in for a size that it cannot know is near the largest long
_made: dict[str, str] = {}  # application → folder, only where the session names none


def local_session(cpus: str = "*", app: str = "millrace", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all work is
    local (tests, a laptop) is a temporary folder made.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY, None
    )
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="millrace-")
    return _made[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's choice."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def split_bytes(spark: SparkSession) -> int:
    """The largest stretch of a file that Spark gives to one task."""
    text = spark.conf.get(SPLIT_KEY)
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


@contextmanager
def splits_of(spark: SparkSession, most: int) -> Iterator[None]:
    """While inside, actions read files in stretches of at most ``most`` bytes; a smaller setting stays."""
    before = spark.conf.get(SPLIT_KEY)
    if split_bytes(spark) > most:
        spark.conf.set(SPLIT_KEY, str(most))
    try:
        yield
    finally:
        spark.conf.set(SPLIT_KEY, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with very few splits over all cores.

    One gzip file or one Parquet row group is one task, however large the cluster.  Text work per
    row costs far more than one shuffle of such an input.  What counts is the estimated size of a
    split, at every size of the input: beyond ``SPLIT_BYTES`` it could not be split by Spark.  Inputs of
    at most ``SMALL_BYTES`` in all cost next to nothing to deal out and are so if most cores would idle.
    An input whose size is not known, like rows from the driver, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = wanted_splits(input_bytes(df), max(1, df.rdd.getNumPartitions()), cores)
    return df.repartition(wanted) if wanted else df


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(size: int, most: int) -> int:
    """How many files of about ``most`` bytes hold ``size`` bytes; one if the size is not known."""
    return 1 if size >= UNKNOWN_BYTES else max(1, -(-size // most))


def wanted_splits(size: int, splits: int, cores: int) -> int | None:
    """Into how many partitions to deal an input of ``size`` bytes, or None to leave it as it is."""
    if size >= UNKNOWN_BYTES:
        return None
    if size <= SMALL_BYTES:
        return cores if splits * 2 <= cores else None
    return max(cores, -(-size // SPLIT_BYTES)) if size / splits > SPLIT_BYTES else None


def spread_once(df: DataFrame) -> DataFrame:
    """An input that must be dealt out is read and shuffled once, not in each pass over it."""
    dealt = spread(df)
    if dealt is df:
        return df
    path = scratch_path(df.sparkSession, "spread")
    dealt.write.parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only picks and computes on the rows of one scan, so that asking for its splits costs nothing."""
    if df.isStreaming:
        return False
    node = df._jdf.queryExecution().sparkPlan()
    while node.nodeName() in ("Project", "Filter", "Generate"):
        node = node.children().head()
    return node.children().isEmpty() and node.nodeName().startswith("Scan")
