"""Helpers shared by the training-data operators: shared storage, bounded
broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textvec import trimmed

#: A side is broadcast only when a count has shown it has at most this many
#: narrow rows (a few machine words each), so at most some tens of MB.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session of one local process that has none (unit tests) gets a
    folder of its own; on a cluster the setting has to be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            found = known
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="wirefold-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables written by this process; ``release`` removes them.
_made: list[str] = []


def made() -> int:
    """How many intermediate tables there are: a mark for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the intermediate tables, once the results that read them are saved.

    Those made before the mark ``since`` stay, and so do the last ``keep``.
    """
    last = len(_made) - keep
    for name in _made[since:last]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:last]


def discard_later(path: str) -> None:
    """Let ``release`` delete a folder of the shared folder, too."""
    _made.append(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, step: Callable, schema: StructType | str, keep: str = "") -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end.

    Only what ``textvec.kept`` holds by the name ``keep`` stays in the worker.
    """
    return df.mapInArrow(lambda batches: trimmed(step(batches), keep), schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the columns of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def bounded_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is.

    Beyond the limit Spark takes its ordinary shuffle join.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for each node of an undirected edge list.

    ``edges`` has columns ``u`` and ``v`` of one orderable type.  Returns
    ``node, component``; nodes without an edge to another are absent.  Null
    ends and loops are ignored; repeated edges are harmless.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): both
    only take a minimum over neighbours, so hubs are pre-aggregated before the
    shuffle and the edge count never grows beyond its start.  The rounds end
    at the fixed point, after about the logarithm of the longest path.
    """
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select("u", "v")
    current = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = written(small, "cc")
        # A fixed point is a set of stars: the same edges twice.
        now = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
