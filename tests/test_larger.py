"""What only larger tables show: cuts, batches that grow, rows sent around."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioweave import catalog
from folioweave.functions.batches import slices
from folioweave.operators import graph, moves, text_index
from folioweave.sources import files, formats


@pytest.fixture
def folder(spark, tmp_path):
    """Writes rows as a table of a folder that queries read; gives the folder and DuckDB over it."""
    con = duckdb.connect()

    def write(name, rows):
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path)

    write.sql = lambda name: con.execute(catalog.ORACLES[name]).fetchall()
    return write


def test_small_negative_means_keep_their_sign(spark, folder):
    rows = [(0, [-3e-7] + [0.5] * 63, 1), (1, [-1e-7] + [0.25] * 63, 1), (5, [1e-7] + [-0.5] * 63, 1), (10, None, 1)]
    d = folder("embeddings", spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    found = {r["doc_id"]: r["vector"] for r in catalog.QUERIES["centroids"](spark, d).collect()}
    assert found == dict(folder.sql("centroids"))
    signs = {k: [math.copysign(1, x) for x in v if x is not None] for k, v in found.items()}
    assert signs == {k: [math.copysign(1, x) for x in v if x is not None] for k, v in folder.sql("centroids")} and signs[0][0] == -1 and signs[1][0] == 1


def test_graph_view_has_more_than_a_hundred_thousand_nodes(spark, folder):
    d = folder("documents", spark.range(107_000).selectExpr("id as doc_id", "'Text' as text", "'en' as lang", "concat('src', id % 3) as source", "4L as n_chars"))
    found = catalog.QUERIES["graph_view_acl"](spark, d)
    assert found.select("src_key").distinct().count() == 107_000 * 19 // 20
    assert sorted(map(tuple, found.collect())) == sorted(folder.sql("graph_view_acl"))


def test_references_without_a_semicolon_are_text(spark, folder):
    html = "<html><title>a &amp; b&amp</title><script>x && y</script><p>AT&T &copy; &copy 1 &quot</p><p>&am</p><p>&#39;&lt;b&gt;&</p></html>"
    assert files.parse_html(html.encode()) == [(1, "a & b&amp\nAT&T © &copy 1 &quot\n&am\n'<b>&", "a & b&amp", None)]
    d = folder("pages", spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert [tuple(r) for r in catalog.QUERIES["html_text"](spark, d).collect()] == folder.sql("html_text")


def test_slices_have_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 3000, 10, 900, 900, 900)] + [None, "é" * 600]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"])
    parts = list(slices(batch.slice(1), 2000))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts[1:] and [p.num_rows for p in parts] == [1, 1, 2, 3, 1]
    assert list(slices(batch.slice(9), 2000)) == []


def test_terms_are_counted_in_parts():
    texts = [f"wort{i} das das {'und ' * 500}" for i in range(3000)]
    counted = list(text_index._counted(iter([pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], names=["id", "text"])])))
    assert max(b.num_rows for b in counted) < 600 and [x for b in counted for x in b.column(0).to_pylist()] == list(range(3000))
    assert {x for b in counted for x in b.column(1).to_pylist()} == {503}
    assert dict(zip(counted[0].column(2)[7].as_py(), counted[0].column(3)[7].as_py(), strict=True)) == {"wort7": 1, "das": 2, "und": 500}


def test_files_are_parsed_and_archived_in_parts(spark, tmp_path):
    content = [bytes(1 << 20) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"/a/{i}.txt" for i in range(20)]), pa.array(content)], names=["path", "content"])
    parts = list(files.parsed_batches(iter([batch]), files.PARSERS))
    assert max(p.num_rows for p in parts) <= 4 and [x for p in parts for x in p.column(1).to_pylist()] == [f"{i}.txt" for i in range(20)]
    formats.register(spark)
    spark.range(20).selectExpr("concat('m', id, '.txt') as path", "cast(repeat('y', 1000000) as binary) as content").coalesce(1).write.format("archive_members").mode("append").save(str(tmp_path / "a"))
    reader = formats._Members({"path": str(tmp_path / "a")})
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in read) <= 5 and sum(b.num_rows for b in read) == 20


def test_rarest_shingles_leave_no_pair_out(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELLS", 64)  # all cells are shared
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    texts = {i: f"{common} " + " ".join(f"w{i // 2}x{j}" if rng.random() < 0.98 else f"z{rng.random()}" for j in range(60)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").unionByName(spark.createDataFrame([(900, ""), (901, None), (902, "kurz"), (903, "kurz ")], "id long, text string"))
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    score = lambda a, b: len(runs[a] & runs[b]) / len(runs[a] | runs[b])
    wanted = {(a, b): score(a, b) for a in texts for b in texts if a < b and score(a, b) >= 0.8} | {(902, 903): 1.0}
    found = {(r["src"], r["dst"]): r["jaccard"] for r in graph.similar_texts(docs).collect()}
    assert found.keys() == wanted.keys() and len(wanted) > 5 and max(abs(found[k] - wanted[k]) for k in wanted) < 1e-12
    own = spark.createDataFrame([(i, 1000, list(range(i * 997, i * 997 + 1000))) for i in range(20)], "id long, n int, h array<long>")
    assert {r["count"] for r in graph._rarest(own, 0.8).groupBy("id").count().collect()} == {201}


def test_walks_broadcast_a_bounded_sum(spark, monkeypatch):
    monkeypatch.setattr(graph, "_FRONT_BYTES", 4000)
    sent, plain = [], F.broadcast
    monkeypatch.setattr(graph.F, "broadcast", lambda df: sent.append(df.count()) or plain(df))
    ring = spark.range(50).selectExpr("concat('n', id) as src_key", "concat('n', (id * 7 + 1) % 50) as tgt_key", "1 + id % 3 as w_eff")
    ranks = graph.pagerank(ring.selectExpr("src_key as node_key"), ring, rounds=4, tolerance=0.0).collect()
    assert len(ranks) == 50 and abs(sum(r["pagerank"] for r in ranks) - 1) < 1e-9
    assert sum(sent) * 34 < 4000 and len(sent) <= 2


def two_sided(spark, documents, hubs=12):
    """Edges of documents to three of the hubs each, by their number: documents with the same remainder have the same links."""
    ends = lambda i: {f"h{i % hubs}", f"h{(i % 3) * 2}", f"h{i % 4 + 6}"}
    return spark.createDataFrame([(f"d{i:05}", h, 1.0 + (h == "h2")) for i in range(documents) for h in sorted(ends(i))], "src_key string, tgt_key string, w_eff double")


def test_classes_of_alike_nodes_hold_every_link(spark, monkeypatch):
    monkeypatch.setattr(graph, "ALIKE", 9)  # some hubs have more links, some fewer
    more = spark.createDataFrame([("x", "y", 1.0), ("x", "z", 1.0), ("h0", "h1", 2.0), ("e1", "h3", 1.0), ("e2", "h3", 2.0), ("s0", "t0", 1.0), ("s0", "t1", 1.0), ("s1", "t0", 1.0), ("s1", "t1", 1.0)], "src_key string, tgt_key string, w_eff double")
    links = graph.undirected(two_sided(spark, 60).unionByName(more))
    own = links.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("links"))
    place, between = graph._alike(links, own.unionByName(spark.createDataFrame([("alone", 3.0, 0), ("aloft", 3.0, 0), ("apart", 4.0, 0)], "node string, k double, links long")))
    classes = {r["node"]: r["q"] for r in place.collect()}
    wanted = {(r["node"], r["other"]): r["w"] for r in links.collect()}
    near = {n: (sorted((b, w) for (a, b), w in wanted.items() if a == n)) for n in classes}
    assert len(classes) == own.count() + 3 and {classes[n] for n in ("alone", "aloft", "apart")} == {"aloft", "apart"}
    for n, q in classes.items():  # the first of those with the same links, or alone
        assert q == (min(m for m in classes if near[m] == near[n]) if 0 < len(near[n]) <= 9 else classes[n] if not near[n] else n)
    linked = {(r["q"], r["p"]): r["w"] for r in between.collect()}
    assert {(a, b): linked[classes[a], classes[b]] for a in classes for b in classes if (classes[a], classes[b]) in linked} == wanted
    assert classes["d00012"] == "d00000" and classes["e1"] != classes["e2"] and classes["s1"] == "s0" and classes["t1"] == "t0"


def test_communities_weigh_alike_nodes_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def look(links, *_):
        raise Seen(links.count())

    monkeypatch.setattr(graph, "_local_moves", look)
    sizes = []
    for documents in (300, 3000):
        with pytest.raises(Seen) as seen:
            graph.communities(spark.createDataFrame([], "node_key string"), two_sided(spark, documents))
        sizes.append(seen.value.args[0])
    assert sizes[0] == sizes[1] < 100  # links weighed in a round: by class, not by document


def test_moves_of_classes_are_those_of_their_nodes(spark):
    links = graph.checkpointed(graph.undirected(two_sided(spark, 500)))
    place, between = graph._alike(links, links.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("links")))
    at = graph.checkpointed(place.withColumn("c", F.when(F.xxhash64("node") % 3 == 0, F.col("node")).otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("node"), F.lit(5))))))
    total = at.agg(F.sum("k")).first()[0]

    def moves(links, at):
        found = graph._wanted(links, at.groupBy("q", "k", "c").agg(F.count("*").alias("n")), total, 10.0)
        return {r["node"]: tuple(r)[1:] for r in at.join(found.withColumnRenamed("c", "to").withColumnRenamed("own", "c"), ["q", "k", "c"]).select("node", "to", F.round("gain", 6), "links_gain").collect()}

    single = moves(links.withColumnsRenamed({"node": "q", "other": "p"}), at.withColumn("q", F.col("node")))
    assert moves(between, at) == single and len(single) > 300


def test_texts_are_searched_once_for_nodes_and_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "/a/", "x.txt", ["t"], "DIN", "DIN 4108-2", None, "indexed"), (2, None, None, [], None, None, 1, "indexed")], "doc_id long, folder string, file_name string, tags array<string>, issuer string, norm_id string, superseded_by long, status string")
    spark.createDataFrame([(1, "Siehe DIN EN ISO 9001 und § 7a."), (2, None), (2, "laut DIN 4108-2")], "doc_id long, text string").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    plain, shared = graph.first_layer(docs, chunks), graph.first_layer(docs, chunks, both=True)
    for one, other in zip(plain, shared, strict=True):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count() > 4
        assert set(chunks.inputFiles()) <= set(one.inputFiles()) and not set(chunks.inputFiles()) & set(other.inputFiles())


def tangled(spark, nodes=100):
    """Groups of nodes with links inside and out, hubs, and nodes with the same links."""
    rng = np.random.default_rng(8)
    pairs = {(f"n{a:03}", f"n{b:03}") for a, b in rng.integers(0, nodes, (nodes * 20, 2)) if a < b and (a % 6 == b % 6 or rng.random() < 0.04)}
    pairs |= {(f"t{i:03}", f"n{j + i % 5:03}") for i in range(2 * nodes) for j in (0, 40, 80)} | {(f"n{i:03}", f"hub{i % 3}") for i in range(0, nodes, 2)}
    return spark.createDataFrame([(a, b, 1.0 + len(b) % 2) for a, b in sorted(pairs)], "src_key string, tgt_key string, w_eff double")


def test_hashes_of_arrays_are_those_of_spark(spark):
    rows = spark.range(50).selectExpr("xxhash64(concat('n', id)) as h", *[f"xxhash64(concat('n', id), {x}) as h{i}" for i, x in enumerate((1801, 0, -7))]).toPandas()
    for i, x in enumerate((1801, 0, -7)):
        assert (moves.hashed(rows["h"].to_numpy(), x).view(np.int64) == rows[f"h{i}"].to_numpy()).all()


def test_rounds_in_one_task_equal_rounds_of_jobs(spark, monkeypatch):
    links = graph.checkpointed(graph.undirected(tangled(spark)))
    own = graph.checkpointed(links.groupBy("node").agg(F.sum("w").alias("k"), F.count("*").alias("links")))
    place, between = graph._alike(links, own)
    total, count = own.agg(F.sum("k"), F.count("*")).first()
    monkeypatch.setattr(graph, "FEW_NODES", -1)
    wanted = graph._local_moves(between, place, total, total / count)
    rows = [sorted(map(tuple, x.select(*sorted(x.columns)).collect())) for x in wanted[:2]]
    monkeypatch.setattr(graph, "FEW_NODES", count)
    begun, plain = [], graph._settled
    monkeypatch.setattr(graph, "_settled", lambda *a: begun.append(a[4]) or plain(*a))
    for few in (900, graph.FEW_LINKS):
        monkeypatch.setattr(graph, "FEW_LINKS", few)
        found = graph._local_moves(between, place, total, total / count)
        assert [sorted(map(tuple, x.select(*sorted(x.columns)).collect())) for x in found[:2]] == rows and found[2] and wanted[2]
    assert begun[0] > 0 and begun[1] == 0 and len({r[0] for r in rows[0]}) < 60  # from some round on, and from the first


def test_rounds_of_a_small_level_are_no_jobs(spark, monkeypatch):
    monkeypatch.setattr(graph, "_wanted", None)
    found = graph.communities(spark.createDataFrame([("alone",)], "node_key string"), two_sided(spark, 300))
    assert [tuple(r) for r in found.collect()] == [("alone", "alone")]
    assert graph.communities(spark.createDataFrame([("a",)], "node_key string"), two_sided(spark, 0)).count() == 1


def test_only_texts_that_meet_are_written(spark, monkeypatch):
    written, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(plain(df)) or written[-1])
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(60)] + [" ".join(f"w7x{j}" for j in range(49)), "w3x0 " * 9]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, texts[0], texts[7]])], "id long, text string")
    found = [(r["src"], r["dst"], r["jaccard"]) for r in graph.similar_texts(docs, but=spark.createDataFrame([(62,), (63,)], "id long")).collect()]
    assert found == [(7, 60, 45 / 46)]
    assert [sorted(r["id"] for r in x.collect()) for x in written if "text" in x.columns] == [[7, 60]]
    assert not [x for x in written if any(kind.startswith("array") for _, kind in x.dtypes)]


def test_places_of_shared_shingles_rule_out_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    texts = {i: [f"w{i // 4}x{j}" for j in range(40 + i // 4 % 30)] for i in range(160)}
    for i, words in texts.items():
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    for least in (0.5, 0.8):
        wanted = {(a, b) for a in texts for b in texts if a < b and len(runs[a] & runs[b]) >= least * len(runs[a] | runs[b]) - 1e-9}
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id long, text string")
        assert {(r["src"], r["dst"]) for r in graph.similar_texts(docs, least).collect()} == wanted and len(wanted) > 10
