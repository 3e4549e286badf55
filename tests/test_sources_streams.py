"""Files, versioned tables, whole plans and streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioweave.functions.folders import Principal
from folioweave.operators import listing, retrieval
from folioweave.operators.text_index import TextIndex
from folioweave.plans import retrieve as plans
from folioweave.session import checkpointed
from folioweave.sources import files
from folioweave.sources.warehouse import Warehouse, migrate
from folioweave.streaming import jobs

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    return packed(**{"word/document.xml": f"<w:document {W}><w:body>{p('Intro')}{p('Kapitel', 'Heading1')}{p('Text')}{p('2.1 Teil', 'Heading')}{p('Mehr')}</w:body></w:document>"})


def xlsx():
    rels = '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    book = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Blatt" r:id="r1"/></sheets></workbook>'
    sheet = f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>'
    return packed(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst {S}><si><t>Kopf</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})


@pytest.fixture()
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "a").mkdir(parents=True)
    (top / "a/x.txt").write_bytes("Grüße \xff".encode("latin-1"))
    (top / "y.html").write_text("<html><title> T </title><script>no</script><p>Ein</p><p>Zwei</p></html>")
    (top / "z.docx").write_bytes(docx())
    (top / "t.xlsx").write_bytes(xlsx())
    (top / "bad.docx").write_bytes(b"nothing")
    (top / "u.bin").write_bytes(b"1")
    return top


def test_parsers_isolate_errors(spark, folder):
    rows = {r["file_name"]: r for r in files.parse_files(files.read_files(spark, str(folder))).collect()}
    pages = lambda name: [tuple(p) for p in rows[name]["pages"]]
    assert pages("y.html") == [(1, "T\nEin\nZwei", "T", None)]
    assert pages("z.docx") == [(1, "Intro", None, None), (2, "Text", "Kapitel", 1), (3, "Mehr", "2.1 Teil", 2)]
    assert pages("t.xlsx") == [(1, "Kopf\t\t7", "Blatt", None)]
    assert rows["bad.docx"]["pages"] is None and rows["bad.docx"]["error"].startswith("BadZipFile") and "no parser" in rows["u.bin"]["error"]


def test_unzip_refuses_bad_members(spark):
    good = packed(**{"a/b.txt": "x", "../c.txt": "y"})
    rows = files.unzip(spark.createDataFrame([("z1", good), ("z2", b"broken")], "path string, content binary")).collect()
    assert {(r["archive"], r["path"], r["error"] is None) for r in rows} == {("z1", "a/b.txt", True), ("z1", "../c.txt", False), ("z2", "", False)}
    many = files.unzip(spark.createDataFrame([("z1", good)], "path string, content binary"), max_members=1).collect()
    assert many[0]["error"] == "archive too large"


def test_warehouse_versions(spark, tmp_path):
    own = Warehouse(spark, str(tmp_path / "w"))
    docs = spark.createDataFrame([(1, "/a/"), (2, "/b/")], "doc_id long, folder string")
    chunks = spark.createDataFrame([(1, "/a/", "x"), (2, "/b/", "y")], "doc_id long, folder string, text string")
    assert own.read("documents") is None and own.count("documents") == 0 and own.read("documents", docs.schema).count() == 0
    own.commit(documents=docs, chunks=chunks)
    own.publish()
    own.append("documents", spark.createDataFrame([(3, 9)], "doc_id long, other int"), docs.schema)
    assert own.count("documents") == 3 and Warehouse(spark, own.path, "current").count("documents") == 2
    assert own.delete_documents([1]) == 1 and own.count("chunks") == 1
    assert own.move_document(2, "c") and not own.move_document(2, "c") and own.read("chunks").first()["folder"] == "/c/"
    assert Warehouse(spark, own.path, "current").read("documents").where("folder = '/a/'").count() == 1
    own.publish()
    assert Warehouse(spark, own.path, "prev").count("documents") == 2
    assert own.prune(0) and Warehouse(spark, own.path, "prev").count("documents") == 2
    own.append("documents", spark.createDataFrame([(4, "/d/")], docs.schema), docs.schema)
    kept = own._folders("documents")[:-1]
    own.move_document(4, "e")  # only the folder with document 4 is written anew
    assert own._folders("documents")[:-1] == kept and len(kept) == 2
    assert own.compact("documents") == 1 and own.compact("documents", 300) > 1 and own.count("documents") == 3
    other = Warehouse(spark, str(tmp_path / "v"))
    own.copy_to(other)
    assert other.count("documents") == own.count("documents") and Warehouse(spark, other.path, "prev").count("documents") == 2
    assert {r["tag"] for r in own.history().collect()} == {"latest", "current", "prev"}
    own.reset("documents", docs.schema)
    assert own.count("documents") == 0 and migrate(docs, own.read("documents")).count() == 2


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    own = Warehouse(spark, str(tmp_path / "w"))
    docs = spark.createDataFrame([(1, "/a/"), (2, "/b/")], "doc_id long, folder string")
    own.commit(documents=docs)
    monkeypatch.setattr(own, "_put", lambda manifest: 1 / 0)  # dies after its folders, before its manifest
    with pytest.raises(ZeroDivisionError):
        own.commit(documents=docs.limit(0))
    assert own.count("documents") == 2
    monkeypatch.undo()
    (tmp_path / "w/manifests/000000000002.json").write_text('{"tags": {"la')  # dies within its manifest
    assert own.count("documents") == 2
    own.append("documents", docs, docs.schema)
    assert own._numbers() == [3, 2, 1] and own.count("documents") == 4
    (tmp_path / "w/manifests/000000000004.json").write_text("x")
    with pytest.raises(Exception, match="(?i)exist"):  # another writer took the number meanwhile
        monkeypatch.setattr(own, "_numbers", lambda: [3, 2, 1])
        own.publish()


def test_ingest_then_retrieve_then_graph(spark, folder):
    text = "Die Norm ÖNORM B 1801-1:2022 regelt Kosten. " * 40
    (folder / "n.txt").write_text(text)
    (folder / "old.txt").write_text(text.replace("2022", "2015"))
    parsed = files.parse_files(files.read_files(spark, str(folder))).withColumn("folder", files.folder_of(F.col("path"), str(folder)))
    docs, chunks = map(checkpointed, plans.ingest(parsed, spark.createDataFrame([], "doc_hash string, folder string")))
    assert docs.count() == 6 and chunks.where("vector is null").count() == 0
    assert {r["doc_version"] for r in docs.where("norm_key = 'önorm_b_1801_1'").collect()} == {"2022", "2015"}
    assert plans.ingest(parsed, docs)[0].count() == 0
    numbered = docs.withColumn("doc_id", F.crc32(F.encode("doc_id", "UTF-8"))).withColumn("superseded_by", F.lit(None).cast("long")).withColumn("tags", F.array(F.lit("t")))
    parts = chunks.withColumn("doc_id", F.crc32(F.encode("doc_id", "UTF-8"))).drop("superseded_by")
    status = listing.version_status(numbered.drop("superseded_by"))
    got = plans.retrieve(parts, status, plans.Request("Norm Kosten", [1.0] + [0.0] * 63, Principal("user", True), top_k=3)).collect()
    assert got and got[0]["file_name"] in ("n.txt", "old.txt") and {r["outdated"] for r in got if r["file_name"] == "old.txt"} <= {True}
    with pytest.raises(PermissionError):
        plans.retrieve(parts, status, plans.Request("x", [1.0] + [0.0] * 63, Principal("user", False, ("/a/",)), folder="/b/"))
    made = plans.refresh_graph(numbered, parts.select("doc_id", "text"), parts.select("doc_id", "vector"), rounds=2)
    assert made["nodes"].agg(F.round(F.sum("pagerank"), 6)).first()[0] == 1.0
    assert made["edges"].where("relation = 'references'").count() >= 2 and made["communities"].count() >= 1


def test_graph_json_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("document:1", "document", "x", ["/a/"]), ("tag:t", "tag", "t", ["/a/"])], "node_key string, node_type string, label string, folder_paths array<string>")
    edges = spark.createDataFrame([("document:1", "tag:t", "has_tag")], "src_key string, tgt_key string, relation string")
    files.write_jsonl(files.graph_json(nodes, edges), str(tmp_path / "g"))
    n, e = files.read_graph_json(spark, str(tmp_path / "g"))
    assert {(r["id"], r["folder"]) for r in n.collect()} == {("document:1", "/a/"), ("tag:t", None)} and e.count() == 1


def test_watched_folder(spark, folder, tmp_path):
    good, dead = [], []
    run = lambda: jobs.ingest(jobs.watch_folder(spark, str(folder)), str(tmp_path / "ck"), lambda df, _: good.extend(r["file_name"] for r in df.collect()), lambda df, _: dead.extend(r["file_name"] for r in df.collect())).awaitTermination()
    run()
    assert sorted(good) == ["t.xlsx", "x.txt", "y.html", "z.docx"] and sorted(dead) == ["bad.docx", "u.bin"]
    (folder / "new.txt").write_text("neu")
    run()
    assert sorted(good)[0] == "new.txt" and len(good) == 5 and len(dead) == 2


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts", "cast(ts as timestamp) as created_at", "value as latency_ms")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))

    def result(df, mode):
        q = df.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).option("checkpointLocation", str(tmp_path / mode)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(f"out_{mode}")

    limited = result(jobs.rate_limit(stream.withWatermark("ts", "40 days"), 3, 3600), "append")
    assert sorted(map(tuple, limited.select("event_id", "allowed").collect())) == sorted(map(tuple, listing.rate_limit(events, 3, 3600).select("event_id", "allowed").collect()))
    windows = result(jobs.rolling_metrics(stream), "complete")
    assert windows.agg(F.sum("queries")).first()[0] == 24 * events.count()


def test_files_are_sniffed_and_parsers_fall_back(spark):
    pdf = lambda data: [files.layout_page(1, [[["a", None], ["b ", "c"]]], [(9.0, 1.0, "low"), (2.0, 1.0, " high ")])]
    empty = lambda data: [(1, "  ", None, None)]
    rows = spark.createDataFrame([("/x/one", b"%PDF-1.7"), ("/x/two.dat", docx()), ("/x/three", b"  <!DOCTYPE html><p>Ein"), ("/x/four", xlsx()), ("/x/five", b"PK\x03\x04broken"), ("/x/six", packed(a="b"))], "path string, content binary")
    parsers = files.PARSERS | {"pdf": files.with_fallback(empty, pdf)}
    got = {r["file_name"]: r for r in files.parse_files(rows, parsers).collect()}
    assert tuple(got["one"]["pages"][0]) == (1, "a | \nb | c\nhigh\nlow", "a |", None)
    assert got["two.dat"]["pages"][0]["text"] == "Intro" and got["three"]["pages"][0]["text"] == "Ein" and got["four"]["pages"][0]["title"] == "Blatt"
    assert "no parser" in got["five"]["error"] and "no parser" in got["six"]["error"]
    assert files.with_fallback(empty)(b"") == [(1, "  ", None, None)]


def test_ingest_into_a_warehouse(spark, folder, tmp_path):
    text = "Die Norm ÖNORM B 1801-1:2022 regelt Kosten. " * 40
    (folder / "n.txt").write_text(text)
    own = Warehouse(spark, str(tmp_path / "w"))

    def take(**more):
        parsed = files.parse_files(files.read_files(spark, str(folder))).withColumn("folder", files.folder_of(F.col("path"), str(folder)))
        return plans.ingest_into(own, parsed, **more)

    assert take(max_bytes=1) == 0 and own.read("documents") is None
    assert take() == 5 and take() == 0
    (folder / "old.txt").write_text(text.replace("2022", "2015"))
    assert take() == 1
    by_name = {r["file_name"]: r for r in plans.stored_documents(own).collect()}
    assert len(by_name) == 6 and by_name["old.txt"]["valid_status"] == "superseded" and by_name["old.txt"]["superseded_by"] == by_name["n.txt"]["doc_id"] and by_name["n.txt"]["valid_status"] == "current"
    docs, chunks = own.read("documents").withColumn("tags", F.array(F.lit("t"))), own.read("chunks").select("doc_id", "chunk_id", "folder", "text", "section_path", "page")
    rows, counters = plans.reindex(docs, chunks)
    assert rows.count() == chunks.count() and rows.where("vector is null or source_type <> 'txt'").count() == 0
    n = {r["doc_id"]: (r["n"], r["missing"]) for r in counters.collect()}
    assert n[by_name["n.txt"]["doc_id"]] == (by_name["n.txt"]["chunk_count"], False) and n[by_name["y.html"]["doc_id"]] == (0, True)


def test_two_ingests_equal_one(spark, folder, tmp_path):
    def parsed(only):
        found = files.parse_files(files.read_files(spark, str(folder))).withColumn("folder", files.folder_of(F.col("path"), str(folder)))
        return found.where(F.col("file_name").rlike(only))

    for i in range(30):
        (folder / f"n{i}.txt").write_text(f"Die Norm ÖNORM B {1800 + i % 4}-1:{2000 + i % 7} regelt Kosten {i}. " * 30)
    at_once, by_turns = (Warehouse(spark, str(tmp_path / name)) for name in ("w1", "w2"))
    assert plans.ingest_into(at_once, parsed(r"^n\d+\.txt$")) == 30
    index = TextIndex(spark, str(tmp_path / "index"), by=("folder",))
    for batch, n in ((r"^n1\d\.txt$", 10), (r"^n[3-9]\.txt$", 7), (r"^n2\d\.txt$", 10), (r"^n1\d\.txt$", 0), (r"^n[0-2]\.txt$", 3)):
        before = {p for p in (tmp_path / "w2").rglob("*.parquet")}
        assert plans.ingest_into(by_turns, parsed(batch), index=index) == n
        assert before <= {p for p in (tmp_path / "w2").rglob("*.parquet")}  # nothing is rewritten
        if n:  # only the batch is written
            new = max((p for p in (tmp_path / "w2" / "documents").iterdir()), key=lambda p: p.stat().st_mtime_ns)
            assert spark.read.parquet(str(new)).count() == n
    names = ["doc_id", "file_name", "norm_key", "valid_status", "superseded_by"]
    rows = [sorted(map(repr, plans.stored_documents(w).select(*names).collect())) for w in (at_once, by_turns)]
    assert rows[0] == rows[1] and len(rows[0]) == 30 and sum("superseded" in x for x in rows[0]) > 10
    assert by_turns.read("norms").count() < 30
    chunks = at_once.read("chunks")
    assert [tuple(r) for r in index.best(["kosten", "norm"], 9).collect()] == [tuple(r) for r in retrieval.bm25(chunks, "kosten norm", 9).collect()]
    newest = {r["norm_key"]: r["newest"]["doc_id"] for r in by_turns.read("norms").groupBy("norm_key").agg(F.min("newest").alias("newest")).collect()}
    by_turns.commit(documents=by_turns.read("documents").where(F.col("doc_id") != min(newest.values())))
    plans.redate(by_turns)
    left = plans.stored_documents(by_turns)
    assert left.count() == 29 and left.where("valid_status = 'current'").select("norm_key").distinct().count() == 4


def test_lenient_requests(spark):
    chunks = spark.createDataFrame([("c1", 1, "/a/", "a.txt", "de", "norm", "Norm Kosten", [1.0, 0.0], 1, None, None)], "chunk_id string, doc_id long, folder string, file_name string, language string, doc_type string, text string, vector array<double>, page int, section_path string, section_title string")
    docs = spark.createDataFrame([(1, "/a/", "current", None)], "doc_id long, folder string, valid_status string, superseded_by long")
    nodes = spark.createDataFrame([("document:1", "document", ["/a/"], 1)], "node_key string, node_type string, folder_paths array<string>, doc_id long")
    broken = spark.createDataFrame([("document:1", "norm:x", "references")], "src_key string, tgt_key string, relation string").where(F.raise_error(F.lit("graph")).isNull())
    request = plans.Request("ISO 9001 Kosten", [1.0, 0.0], Principal("user", True), walk=True)
    with pytest.raises(Exception, match="graph"):
        plans.retrieve_now(chunks, docs, request, nodes, broken)
    request.lenient = True
    assert [r["chunk_id"] for r in plans.retrieve_now(chunks, docs, request, nodes, broken).collect()] == ["c1"]
    assert plans.retrieve_now(chunks.where(F.raise_error(F.lit("search")).isNull()), docs, request).count() == 0


def test_graph_cache(spark):
    nodes = spark.createDataFrame([("document:1", "document", ["/a/"], 1)], "node_key string, node_type string, folder_paths array<string>, doc_id long")
    edges = spark.createDataFrame([("document:1", "norm:x", "references")], "src_key string, tgt_key string, relation string")
    now, version, loads = [0.0], [1], []
    cache = plans.GraphCache(lambda: loads.append(1) or (nodes, edges), lambda: version[0], 30.0, lambda: now[0])
    assert [tuple(r) for r in cache.get()["referring"].collect()] == [("norm:x", 1)] and cache.get()["adjacency"].count() == 2
    version[0] = 2
    now[0] = 29.0
    cache.get()
    assert len(loads) == 1
    now[0] = 31.0
    cache.get()
    assert len(loads) == 2
    now[0] = 70.0
    cache.get()
    assert len(loads) == 2
    cache.invalidate()
    cache.get()
    assert len(loads) == 3


def test_sessions_expire(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:30:00"), ("a", "2024-01-01 00:50:00"), ("c", "2024-01-01 01:45:00")], "session_id string, started string").selectExpr("session_id", "cast(started as timestamp) as started")
    for i, r in enumerate([rows, rows.limit(0).unionByName(spark.createDataFrame([("d", "2024-01-01 01:46:00")], "session_id string, started string").selectExpr("session_id", "cast(started as timestamp) as started"))]):
        r.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "s")).withWatermark("started", "0 seconds")
        jobs.expired_sessions(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema("session_id string, started timestamp").parquet(str(tmp_path / "out"))
    assert sorted((r["session_id"], str(r["started"])) for r in got.collect()) == [("b", "2024-01-01 00:30:00")]
