"""Components are found once, vectors are not sent along edges, and written tables leave no shuffle files."""

import pytest

from spectrafold.catalog import REGISTRY
from spectrafold.operators import graphs
from spectrafold.session import saved
from test_resistances import _graph, _links


@pytest.mark.parametrize("name", ["node_pair_resistance", "resistance_estimates"])
def test_components_are_found_once(spark, tmp_path, monkeypatch, name):
    rows = [(flag, part, part % 3 + 4 * (part > 5)) for flag in "AN" for part in range(12)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    calls, found = [], graphs.connected_components
    monkeypatch.setattr(graphs, "connected_components", lambda edges, *rest: calls.append(1) or found(edges, *rest))
    got = REGISTRY[name].run(spark, str(tmp_path)).collect()
    assert len(calls) == 1 and {r.graph_id for r in got} == {"A", "N"}


def test_vectors_are_not_sent_along_edges_of_held_components(spark, monkeypatch):
    edges = saved(spark.createDataFrame(_graph("g", _links(2)) + _graph("two", [(0, 1), (1, 2), (2, 0), (10, 11)]), "graph_id string, src long, dst long"))
    places, parts = saved(graphs.resistance_embedding(edges, columns=6)), graphs.connected_components(edges)
    held = graphs.resistance_estimates(edges, places, parts)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan
    monkeypatch.setattr(graphs, "HELD_EDGES", 10)
    rows = {r.graph_id: r for r in held.collect()}
    for r in graphs.resistance_estimates(edges, places, parts).collect():  # the larger graph by joins
        assert all(abs(x - y) <= 1e-9 * abs(x) for x, y in zip(r[1:], rows.pop(r.graph_id)[1:]))
    assert not rows


def test_shuffle_files_of_written_tables_are_deleted(spark):
    saved(spark.range(100_000).repartition(3, "id").groupBy("id").count())
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    last = max(int(n.split("_")[1]) for n in names if n.startswith("shuffle_")) if any(n.startswith("shuffle_") for n in names) else -1
    saved(spark.range(100_000).repartition(3, "id").groupBy("id").count())
    files = manager.getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    assert not [n for n in names if n.startswith("shuffle_") and int(n.split("_")[1]) > last]
