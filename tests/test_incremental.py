"""Components kept in a log against components computed from all edges, over random changes."""

import random

import pytest

from lettermill.operators.components import connected_components
from lettermill.operators.incremental import ComponentLog


def whole(spark, edges):
    found = connected_components(spark.createDataFrame(sorted(edges), "u string, v string"))
    return {r.node: r.component for r in found.collect()}


def test_log_follows_random_changes(spark, tmp_path):
    rng = random.Random(3)
    log, edges = ComponentLog(spark, f"file://{tmp_path}/log"), set()
    assert log.labels().count() == 0 and log.version() == 0
    for step in range(7):
        if step in (2, 4, 6):
            nodes = {x for e in edges for x in e}
            gone = set(rng.sample(sorted(nodes), len(nodes) // 6)) | {"nobody"}
            log.remove(spark.createDataFrame([(x,) for x in sorted(gone)] + [(None,)], "node string"))
            edges = {e for e in edges if not set(e) & gone}
        else:
            new = [tuple(f"n{rng.randrange(60):02d}" for _ in range(2)) for _ in range(14)]
            log.add(spark.createDataFrame([*new, new[0], ("a", None), (None, "b"), ("c", "c")], "u string, v string"))
            edges |= {e for e in new if e[0] != e[1]}
        assert log.version() == step + 1
        assert {r.node: r.component for r in log.labels().collect()} == whole(spark, edges), step


def test_only_what_a_change_touches_is_written(spark, tmp_path):
    log = ComponentLog(spark, f"file://{tmp_path}/log")
    log.add(spark.range(3000).selectExpr("concat('a', lpad(id, 5, '0')) as u", "concat('k', id div 3) as v"))
    log.add(spark.createDataFrame([("a00000", "k1"), ("zz", "k2")], "u string, v string"))
    log.remove(spark.createDataFrame([("a00001",)], "node string"))
    # two components of four become one, whose least node stays; a new node joins another; a node leaves
    written = [spark.read.parquet(f"{tmp_path}/log/labels/version={v}").count() for v in (2, 3)]
    assert written == [5, 1] and spark.read.parquet(f"{tmp_path}/log/edges/version=3").count() == 1


def test_two_changes_of_one_version(spark, tmp_path, monkeypatch):
    log = ComponentLog(spark, f"file://{tmp_path}/log")
    edge = spark.createDataFrame([("a", "b")], "u string, v string")
    log.add(edge)
    monkeypatch.setattr(ComponentLog, "version", lambda self: 0)
    with pytest.raises(RuntimeError):
        log.add(edge)
    monkeypatch.undo()
    assert log.version() == 1 and log.labels().count() == 2
