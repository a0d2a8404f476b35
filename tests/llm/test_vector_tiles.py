"""Tiles of vectors, and the vectors that every partition offers for the sample, never go through the driver."""

import random
import re

from spectrafold.llm import vectors
from spectrafold.llm.common import Scratch


def test_tiles_and_offers_for_the_sample_stay_with_the_tasks(spark, monkeypatch):
    rng, plans, save = random.Random(3), [], Scratch.save

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", noted)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(30)]
    rows += [(100 + k, [x * 2 for x in v]) for k, v in rows[:5]]  # the same directions
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lists=4, probes=4)
    joins = lambda plan: re.findall(r"(\w+Join) \[", plan)
    (search,) = [p for p in plans if "asking" in p]
    # below it, numbers of tiles, a row a list, may be broadcast
    assert joins(search)[0] == "SortMergeJoin" and any("TakeOrderedAndProject" in p for p in plans)
    assert set(joins(got._jdf.queryExecution().executedPlan().toString())) == {"SortMergeJoin"}
    found = {r.vec_id: r for r in got.collect()}
    assert all(found[100 + k].component_id == found[k].component_id and found[k].n_links >= 1 for k in range(5))
