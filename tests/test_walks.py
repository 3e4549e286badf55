"""Walks that pass on changes only, against the power iteration written out."""

import numpy as np
import pytest

from folioweave.operators import graph


@pytest.fixture(scope="module")
def linked(spark):
    """600 nodes in 30 groups with few links between them; every tenth node has no way out, three stand alone."""
    rng = np.random.default_rng(5)
    rows = [(f"n{a}", f"n{a // 20 * 20 + rng.integers(20) if rng.random() < 0.98 else rng.integers(600)}", float(rng.integers(1, 5))) for a in range(600) if a % 10 for _ in range(4)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(603)] + [("n1",)], "node_key string")
    return nodes, spark.createDataFrame(rows + [("n1", "nowhere", 9.0), ("n3", "n4", 0.0), ("n3", "n4", None)], "src_key string, tgt_key string, w_eff double"), rows + [("n3", "n4", 1.0)] * 2


def power(rows, p, keep, rounds, tolerance):
    at = lambda key: int(key[1:])
    m = np.zeros((len(p), len(p)))
    for a, b, w in rows:
        m[at(b), at(a)] += w
    out = m.sum(axis=0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    r = p.copy()
    for _ in range(rounds):
        new = (1 - keep) * p + keep * (m @ r + r[out == 0].sum() * p)
        change = np.abs(new - r).sum()
        r = new
        if change < tolerance:
            break
    return r


@pytest.mark.parametrize("bytes_", [graph._FRONT_BYTES, 0])
def test_personalised_walk(spark, linked, monkeypatch, bytes_):
    monkeypatch.setattr(graph, "_FRONT_BYTES", bytes_)
    nodes, edges, rows = linked
    p = np.zeros(603)
    p[[1, 2]] = 0.5
    moved = []
    both = rows + [(b, a, w) for a, b, w in rows]
    links = edges.selectExpr("src_key", "tgt_key", "coalesce(nullif(w_eff, 0), 1) as w")
    start = nodes.distinct().selectExpr("node_key", "if(node_key in ('n1', 'n2'), 0.5D, 0D) as p")
    found = graph._walk(start, links.union(links.selectExpr("tgt_key", "src_key", "w")), 0.7, 40, 1e-6, moved)
    got = {r["node_key"]: r["r"] for r in found.collect()}
    assert len(got) == 603 and max(abs(got[f"n{i}"] - x) for i, x in enumerate(power(both, p, 0.7, 200, 1e-13))) < 1e-6
    assert moved[0] == 2 and max(moved) < 603 and moved[-1] < max(moved)  # starts at the seeds, and fades


def test_pagerank_to_a_billionth(spark, linked):
    nodes, edges, rows = linked
    got = {r["node_key"]: r["pagerank"] for r in graph.pagerank(nodes, edges, rounds=6, tolerance=0.0).collect()}
    p = np.full(603, 1 / 603)
    assert max(abs(got[f"n{i}"] - x) for i, x in enumerate(power(rows, p, 0.85, 6, 0.0))) < 1e-14
    got = {r["node_key"]: r["pagerank"] for r in graph.pagerank(nodes, edges, tolerance=1e-4).collect()}
    assert max(abs(got[f"n{i}"] - x) for i, x in enumerate(power(rows, p, 0.85, 500, 1e-15))) < 1e-4 and abs(sum(got.values()) - 1) < 1e-3


def test_walks_without_links_or_seeds(spark, linked):
    nodes, edges, _ = linked
    alone = graph.pagerank(nodes, edges.limit(0))
    assert {round(r["pagerank"], 12) for r in alone.collect()} == {round(1 / 603, 12)}
    none = graph.personalised(nodes, edges, nodes.limit(0))
    assert {r["score"] for r in none.collect()} == {0.0} and graph.pagerank(nodes.limit(0), edges).count() == 0


def test_all_nodes_are_not_broadcast(spark, linked, monkeypatch):
    plans, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df))
    monkeypatch.setattr(graph, "SENT_ROWS", 600, raising=False)
    monkeypatch.setattr(graph, "_FRONT_BYTES", 0)
    nodes, edges, rows = linked
    ranks = graph.pagerank(nodes, edges, rounds=2, tolerance=0.0)
    members = nodes.selectExpr("node_key", "node_key as community_id")
    graph.checkpointed(graph.participation(members, edges))
    assert ranks.count() == 603 and sum("SortMergeJoin" in x for x in plans) > 4
    assert not [x for x in plans if "BroadcastHashJoin" in x]
