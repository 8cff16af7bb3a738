"""Every mapping query beside its SQL in DuckDB, on the smallest tables; and the contract of the entry file."""

import os

import duckdb
import numpy as np
import pytest

from cellweave.operators import graph
from cellweave.plans import bindings, catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "null" if v is None or v is np.nan or v != v else repr(float(v) + 0.0) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_solvers_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_every_graph_is_optimised(spark):
    got = catalogue.QUERIES["pose_graph_optimize"](spark, DATA).toPandas()
    nodes, edges = (d.toPandas() for d in bindings.graph(spark, DATA))
    assert sorted(zip(got.robot, got.id)) == sorted(zip(nodes.robot, nodes.id)) and got.robot.nunique() > 1
    for robot in sorted(set(got.robot))[:2]:
        own, links = (spark.createDataFrame(d[d.robot == robot]) for d in (nodes, edges))
        out, chi2 = graph.optimise(spark, own, links)
        want, mine = out.toPandas().sort_values("id"), got[got.robot == robot].sort_values("id")
        assert np.allclose(mine[["x", "y", "theta"]], want[["x", "y", "theta"]], atol=1e-6)
        assert np.allclose(mine.chi2_first, chi2[0]) and np.allclose(mine.chi2_last, chi2[-1])


def test_entry_file(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_neighbour_joins_are_equi_joins(spark):
    plan = catalogue.QUERIES["block_neighbors"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = catalogue.QUERIES["voxel_bin_counts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "partial_count" in plan


@pytest.mark.parametrize("name", ["d2d_score_terms", "p2d_score_terms"])
def test_score_terms_send_each_row_once(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Generate" not in plan and "Window" not in plan


def test_correlative_search_sends_points_before_rotations(spark):
    plan = catalogue.QUERIES["correlative_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "theta" in line]
    at = next(i for i, line in enumerate(plan.splitlines()) if "Generate explode" in line and "-1.6" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    assert not [line for line in plan.splitlines()[:at] if "Exchange hashpartitioning" in line and depth(line) < depth(plan.splitlines()[at])]
