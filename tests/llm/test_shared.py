import random
from types import SimpleNamespace

import pytest

from tickframe.llm import shared


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def tasks_of(spark, group, run):
    """What run returns, and the number of tasks that Spark ran for it."""
    spark.sparkContext.setJobGroup(group, group)
    out, status = run(), spark.sparkContext.statusTracker()
    spark.sparkContext._jsc.clearJobGroup()
    stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
    return out, sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)


@pytest.mark.parametrize("held", [100_000, 50])
def test_rounds_of_components_have_tasks_by_their_links(spark, monkeypatch, held):
    """Few links leave few files, however many shuffle partitions there are; chains, a star and a ring in one task and in several."""
    monkeypatch.setattr(shared, "LINKS", held, raising=False)
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(200 + i, 200 + (i + 1) % 20) for i in range(20)]
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows, tasks = tasks_of(spark, f"components-{held}", lambda: shared.components(spark.createDataFrame(links, "a long, b long")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.node: r.component for r in rows} == {x: 0 if x <= 40 else 100 if x < 200 else 200 for link in links for x in link}
    assert held == 50 or tasks < 400


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared.shared_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared.shared_folder(session("local[4]", None))
    with pytest.raises(ValueError):
        shared.shared_folder(session("spark://host:7077", None))


def test_samples_are_bounded_and_agree_between_runs(spark):
    rows = [(i, f"text {i}") for i in range(500)]
    one = spark.createDataFrame(rows + rows[:1] * 400, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, shared.sampled(one, 60, "doc_id", "text").collect()))
    assert 30 <= len(got) <= 60 and len(set(got)) == len(got)
    assert got == sorted(map(tuple, shared.sampled(one.repartition(3), 60, "doc_id", "text").collect()))
    assert shared.sampled(one, 5000, "doc_id", "text").count() == 500
    assert shared.sampled(one.limit(0), 5, "doc_id").count() == 0


def test_names():
    assert shared.fresh(["Turn", "x"], "turn") == "turn_" and shared.fresh(["x"], "turn") == "turn"
