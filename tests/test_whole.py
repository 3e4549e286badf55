"""Queries that do the whole job, on small tables of hard rows against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave import catalog
from folioweave.functions import text as T
from folioweave.operators import graph


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows as a table of a folder that queries read."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def brute_tags(text):
    head = text[:1500].lower()
    prefix = "(?:önorm|oenorm|onorm|din|en|iso|iec)"
    found = [re.sub("^(oenorm|onorm)$", "önorm", m) for m in re.findall(rf"\b({prefix})(?:\s+{prefix})*\s+[a-z]?\s*\d\d", head)]
    found += ["oib"] if re.search(r"\boib\b", head) else []
    n, first = {}, {}
    for i, w in enumerate(re.findall(r"[A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß\-]{4,}", text[:200_000])):
        w = w.lower().strip("-")
        if len(w) >= 5 and w not in T.STOP and not re.fullmatch("[ivxlcdm]+", w):
            n[w] = n.get(w, 0) + 1
            first.setdefault(w, i)
    ranked = sorted((w for w in n if n[w] >= 2), key=lambda w: (-n[w] * (1 + min(len(w), 16) / 20), first[w]))
    return ",".join(list(dict.fromkeys([*found, *(w[:64] for w in ranked[:10])]))[:7])


def test_tags_of_every_document(spark, folder):
    texts = [
        "Nach ÖNORM B 1801-1 und DIN EN ISO 9001 sowie der OIB-Richtlinie 2: Beton, Beton und Stahl, Stahl, Stahl.",
        "when then been, taken taken garden garden garden",  # ends in en and n before other characters
        "OENORM B 2110, önorm b 2111, EN 1992-1-1, IEC 60364; Leitung Leitung",
        "plain words without any", "", "x" * 1490 + " ISO 27001 ISO 27002 window window",
    ]
    d = folder("documents", list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["tags"] for r in catalog.QUERIES["autotags_all"](spark, d).collect()}
    assert found == {i: brute_tags(t) for i, t in enumerate(texts)}
    assert found[0].startswith("önorm,din,oib,") and found[1].startswith("garden,taken")


def test_references_inside_long_texts(spark, folder):
    long = "garden window " * 20_000
    texts = ["nothing", f"{long} ÖNORM B 1801-1:2022 {long} siehe § 16 und Artikel 17", f"DIN 4108-2, DIN 4108-2 und din 4108-2 {long} EN 1992", None]
    rows = [(doc, t, "de", "src0", len(t or "")) for doc, t in zip([7, 8, 14, 21], texts, strict=True)]
    d = folder("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    inside = {7: set(), 8: {"norm:önorm_b_1801_1", "legal:par_16", "legal:art_17"}, 14: {"norm:din_4108_2", "norm:en_1992"}, 21: set()}
    first = {i: {f"norm:din_en_iso_{9000 + i % 10}", f"legal:par_{i % 30}a", f"legal:art_{i % 9 + 1}"} | ({f"norm:önorm_b_{1000 + i % 40}_1"} if i % 7 else set()) for i in inside}
    expected = {(i, ref) for i in inside for ref in inside[i] | first[i]}
    found = [tuple(r) for r in catalog.QUERIES["refs_extract"](spark, d).select("doc_id", "ref").collect()]
    assert sorted(found) == sorted(expected)
    edges = catalog.QUERIES["graph_l1_edges"](spark, d).where("relation = 'references'").collect()
    assert {(r["src_key"], r["tgt_key"]) for r in edges} == {(f"document:{i}", ref) for i, ref in expected}
    nodes = {r["node_key"] for r in catalog.QUERIES["graph_l1_nodes"](spark, d).collect()}
    assert {ref for _, ref in expected} <= nodes
    metadata = {r["doc_id"]: (r["own"], r["issuer"]) for r in catalog.QUERIES["metadata_all"](spark, d).collect()}
    assert metadata == {7: ("DIN EN ISO 9007", "DIN"), 8: ("ÖNORM B 1008-1", "Austrian Standards"), 14: ("DIN 4108-2", "DIN"), 21: ("DIN EN ISO 9001", "DIN")}


def test_exact_copies_are_linked(spark, folder):
    a, b = "the quick brown fox jumps over the lazy dog again", " ".join(f"w{i}" for i in range(300))
    texts = [a, a, b, "", b.replace("w150", "zz"), a, b, "", None, None]
    d = folder("documents", list(enumerate(texts)), "doc_id long, text string")
    found = {(r["src"], r["dst"]): r["jaccard"] for r in catalog.QUERIES["shingles_exact_jaccard_all"](spark, d).collect()}
    assert found == {(0, 1): 1.0, (0, 5): 1.0, (2, 6): 1.0, (3, 7): 1.0, (2, 4): pytest.approx(291 / 301, abs=1e-6)}


def test_communities_settle_and_contract(spark):
    n = 8  # a ring of triangles
    pairs = [(f"n{3 * i + a}", f"n{3 * i + b}", 1.0) for i in range(n) for a, b in ((0, 1), (0, 2), (1, 2))] + [(f"n{3 * i + 2}", f"n{3 * ((i + 1) % n)}", 1.0) for i in range(n)]
    edges = spark.createDataFrame(pairs, "src_key string, tgt_key string, w_eff double")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(3 * n)], "node_key string")
    found = graph.communities(nodes, edges).cache()
    by = {r["node_key"]: r["community_id"] for r in found.collect()}
    assert len(by) == 3 * n and all(len({by[f"n{3 * i + a}"] for a in range(3)}) == 1 for i in range(n))
    total = 2.0 * len(pairs)

    def quality(of):
        volume, inner = {}, 0.0
        for a, b, w in pairs:
            volume[of[a]], inner = volume.get(of[a], 0.0) + w, inner + 2 * w * (of[a] == of[b])
            volume[of[b]] = volume.get(of[b], 0.0) + w
        return inner / total - sum((v / total) ** 2 for v in volume.values())

    q, groups = quality(by), set(by.values())
    assert q == pytest.approx(graph.modularity(found, edges))
    # no two communities gain by becoming one: the levels have ended
    assert all(quality({k: x if v == y else v for k, v in by.items()}) <= q + 1e-9 for x in groups for y in groups if x < y)


def sequential_louvain(links, rng):
    """Modularity of moves one by one and contraction, written out."""
    near = {}
    for a, b, w in links:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    place = {n: n for n in near}
    inner = dict.fromkeys(near, 0.0)
    while True:
        k = {n: sum(near[n].values()) + inner[n] for n in near}
        total, at, volume, moved = sum(k.values()), {n: n for n in near}, dict(k), False
        again = True
        while again:
            again = False
            for n in rng.permutation(sorted(near)).tolist():
                to = {at[n]: 0.0}
                for o, w in near[n].items():
                    to[at[o]] = to.get(at[o], 0.0) + w
                volume[at[n]] -= k[n]
                best = max(to, key=lambda c: (round(to[c] - k[n] * volume[c] / total, 9), c == at[n]))
                again, moved, at[n] = again or best != at[n], moved or best != at[n], best
                volume[best] += k[n]
        if not moved:
            return sum(inner.values()) / total - sum((v / total) ** 2 for v in volume.values())
        place = {n: at[c] for n, c in place.items()}
        new, own = {c: {} for c in set(at.values())}, dict.fromkeys(set(at.values()), 0.0)
        for n in near:
            own[at[n]] += inner[n]
            for o, w in near[n].items():
                if at[n] == at[o]:
                    own[at[n]] += w
                else:
                    new[at[n]][at[o]] = new[at[n]].get(at[o], 0.0) + w
        near, inner = new, own


def test_communities_of_a_thousand_nodes_equal_moves_one_by_one(spark):
    rng = np.random.default_rng(5)
    group = rng.integers(0, 25, 1000)
    near = {(int(a), int(b)) for a, b in rng.integers(0, 1000, (60_000, 2)) if a < b and (group[a] == group[b] or rng.random() < 0.02)}
    hubs = {(i, 990 + i % 10) for i in range(0, 980, 2)}  # ten nodes that touch half of all
    links = [(f"n{a:04}", f"n{b:04}", 1.0) for a, b in sorted(near | hubs)]
    edges = spark.createDataFrame(links, "src_key string, tgt_key string, w_eff double")
    nodes = spark.createDataFrame([(f"n{i:04}",) for i in range(1000)], "node_key string")
    found = graph.checkpointed(graph.communities(nodes, edges))
    least = min(sequential_louvain(links, np.random.default_rng(i)) for i in range(3))
    assert found.count() == 1000 and graph.modularity(found, edges) >= least - 0.02


def test_size_of_a_cut_plan_stays_that_of_its_rows(spark):
    rows = spark.range(200).selectExpr("id", "id % 7 as g")
    for _ in range(20):  # each round joins twice what it made
        rows = graph.checkpointed(rows.join(rows.groupBy("g").agg(F.count("*").alias("n")), "g").select("id", "g"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert rows.count() == 200 and size < 100_000


def test_fingerprints_of_large_communities(spark):
    members = spark.range(30_000).selectExpr("concat('n:', id) as node_key", "if(id < 29000, 'big', 'small') as community_id")
    marks = {r["community_id"]: r for r in graph.describe_communities(members.unionByName(members.limit(10)), members.selectExpr("node_key", "cast(substring(node_key, 3) as double) as pagerank")).collect()}
    for name, ids in (("big", range(29_000)), ("small", range(29_000, 30_000))):
        joined = "\x1f".join(sorted(f"n:{i}" for i in ids))
        assert marks[name]["size"] == len(ids) and marks[name]["label"] == str(max(ids)) and marks[name]["member_fingerprint"] == hashlib.sha1(joined.encode()).hexdigest()


def plain_mutual(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    near = {i: {ids[j]: s[n, j] for j in sorted(range(len(ids)), key=lambda j: (-s[n, j], ids[j]))[:k] if s[n, j] >= least} for n, i in enumerate(ids)}  # noqa: B023
    return {(i, j): round(float(v), 6) for i in ids for j, v in near[i].items() if i < j and i in near[j]}


def test_mutual_neighbours_skip_blocks_and_lose_none(spark):
    rng = np.random.default_rng(6)
    topic = rng.normal(0, 1, (30, 24))
    vectors = {i: (topic[i % 30] + rng.normal(0, 0.18, 24)).tolist() for i in range(900)}
    vectors |= {i: [float(x) for x in topic[0]] for i in range(900, 1000)} | {1000: [0.0] * 24}  # one very common vector, one of length 0
    centers = spark.createDataFrame(list(vectors.items()), "doc_id long, vector array<double>")
    found = {(r["src"], r["dst"]): r["score"] for r in graph.mutual_neighbours(centers, 8, 0.6, 25).collect()}
    assert found == plain_mutual(vectors, 8, 0.6) and len(found) > 1000
    dealt, blocks = graph.neighbour_blocks(centers, 0.6, 25)
    opened = dealt.select("low", "high").distinct().count()
    assert blocks > 40 and opened < 0.25 * blocks * (blocks + 1) / 2, (opened, blocks)
    assert dealt.groupBy("low", "high", "side").count().agg(F.max("count")).first()[0] <= 60


def test_mutual_neighbours_of_few_rows(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, vector array<double>")
    assert graph.mutual_neighbours(rows()).count() == 0 and graph.mutual_neighbours(rows((1, [1.0, 0.0]))).count() == 0
    assert [tuple(r) for r in graph.mutual_neighbours(rows((1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]))).collect()] == [(1, 2, 0.998752)]
    with pytest.raises(ValueError, match="above 0"):
        graph.mutual_neighbours(rows(), least=0.0)


def test_large_buckets_are_split_and_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    n = 3000
    signed = rng.integers(0, 2**32, (n, graph.PERMUTATIONS))
    signed[:, : graph.ROWS] = signed[0, : graph.ROWS]  # unlike texts with one band in common
    signed[:, 40:48] = signed[1, 40:48]
    for i in range(0, 300, 3):  # pairs that differ in up to 19 places, those in the shared bands aside
        signed[i + 1] = signed[i]
        at = rng.permutation(np.setdiff1d(np.arange(graph.PERMUTATIONS), np.r_[0 : graph.ROWS, 40:48]))[: i % 20]
        signed[i + 1, at] += 1
    classes = spark.createDataFrame([(i, x) for i, x in enumerate(signed.tolist())], "first long, signature array<long>")
    found = {tuple(r) for r in graph.band_pairs(graph.checkpointed(classes)).collect()}
    assert {(i, i + 1) for i in range(0, 300, 3)} <= found and len(found) < n * np.log2(n)
