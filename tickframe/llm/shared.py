"""What several operators need: inputs, cut lineage, components."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir, without its lineage.

    The folder that the session names is used; see shared_folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder in local mode (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def bare(docs: DataFrame, *outputs: str) -> DataFrame:
    """docs without columns of the outputs' names, in any case of letters: an operator's output takes their place."""
    taken = {o.lower() for o in outputs}
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken))


def fresh(columns: list[str], stem: str) -> str:
    """A name like stem that is none of the columns', in any case of letters."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def fields_of(docs: DataFrame) -> str:
    """The schema of docs as text for mapInArrow."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def sampled(rows: DataFrame, sample: int, *by: str) -> DataFrame:
    """At most `sample` different rows of rows, the ones of the least hashes of the columns `by`.

    A first pass lets through those whose hash is under a bound that the row
    count gives, so that few rows are sorted; rows that agree in `by` are one.
    """
    n = rows.count()
    turn = fresh(rows.columns, "turn")
    share = int(min(1.0, 1.5 * sample / max(1, n)) * (1 << 30))
    few = rows.withColumn(turn, F.xxhash64(*by, F.lit(5))).where(F.pmod(turn, F.lit(1 << 30)) < share)
    one = few.groupBy(turn).agg(F.min(F.struct(*rows.columns)).alias("row"))
    return one.orderBy(F.pmod(turn, F.lit(1 << 30)), turn).limit(sample).select("row.*")


#: Links that a task of components takes; fewer are not dealt out.
LINKS = 100_000


def _lowest(rows: DataFrame, tasks: int) -> DataFrame:
    """rows (a, b) and m, the least b of their a, in so many tasks."""
    rows = rows.coalesce(tasks)
    if tasks == 1:  # a join would deal both sides out over all shuffle partitions
        return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return rows.join(rows.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "a").coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): rows (node, component).

    Component is the smallest node reachable. Every node of a link has one
    row; a node in no link has none. Alternating large-star and small-star
    steps: each is an aggregation (combined before its shuffle) and a join
    whose one side has a row per node, so that Spark can split hot nodes.
    A round has a task for each LINKS links and not for each shuffle
    partition: the rounds are many, and each task leaves files.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    tasks, before = max(1, math.ceil(edges.count() / LINKS)), None
    edges = edges.coalesce(tasks)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _lowest(both, tasks).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        edges = cut(
            _lowest(large.distinct(), tasks)
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().coalesce(tasks)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by key, cut anew so that no group of a key is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if at or (held and held[-1].column(key)[-1] != batch.column(key)[0]):
            if whole := [*held, *([batch.slice(0, at)] if at else [])]:
                yield pa.concat_batches(whole)
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links between 0 .. n-1: members and their smallest index."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]
