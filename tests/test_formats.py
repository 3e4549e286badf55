"""Folders and archives as data sources: the rows of the functions on whole files, planned by size."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioweave.functions.folders import Principal
from folioweave.sources import files, formats


@pytest.fixture()
def tree(spark, tmp_path):
    formats.register(spark)
    top = tmp_path / "in dir"
    (top / "a/_hidden").mkdir(parents=True)
    for i in range(20):
        (top / f"a/n{i:02d}.txt").write_text(f"Text {i} " * 50)
    (top / "y.html").write_text("<title>T</title><p>Ein</p>")
    (top / "bad.docx").write_bytes(b"nothing")
    (top / "leer.txt").write_bytes(b"")
    (top / "a/_hidden/z.txt").write_text("no")
    (top / ".dot.txt").write_text("no")
    return top


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_documents_equal_parsed_files(spark, tree):
    read = spark.read.format("document_files")
    whole = read.load(str(tree))
    assert rows(whole.where("size_bytes > 0")) == rows(files.parse_files(files.read_files(spark, str(tree)))) and whole.count() == 23
    assert whole.where("size_bytes = 0").first()["pages"][0]["text"] == ""  # Spark leaves files without bytes out
    assert whole.where("error is not null").count() == 1
    parts = read.option("partition_bytes", "1500").load(str(tree))
    assert whole.rdd.getNumPartitions() == 1 < 5 < parts.rdd.getNumPartitions() < 23 and rows(parts) == rows(whole)
    one = read.option("partition_bytes", "1").load(str(tree)).where("file_name like 'n1%' and file_name <> 'n13.txt' and size_bytes > 0")
    assert one.rdd.getNumPartitions() == 10 and sorted(r["file_name"] for r in one.collect()) == [f"n1{i}.txt" for i in range(10) if i != 3]
    assert read.load(f"{tree}/y.html").first()["pages"][0]["title"] == "T"
    (tree / "none").mkdir()
    assert read.load(f"{tree}/none").count() == 0
    with pytest.raises(Exception, match="missing"):
        read.load(f"{tree}/missing").count()


def test_members_equal_unzipped_archives(spark, tree):
    with zipfile.ZipFile(tree / "big.zip", "w") as z:
        for i in range(40):
            z.writestr(f"d{i % 3}/m{i}.txt", f"{i} " * 500)
        z.writestr("../out.txt", "x")
    damaged = io.BytesIO()
    with zipfile.ZipFile(damaged, "w") as z:
        z.writestr("good.txt", "good")
        z.writestr("torn.txt", "torn apart")
    (tree / "torn.zip").write_bytes(damaged.getvalue().replace(b"torn apart", b"torn upart", 1))
    (tree / "a/broken.zip").write_bytes(b"broken")
    zipfile.ZipFile(tree / "empty.zip", "w").close()
    read = spark.read.format("archive_members")
    whole = read.load(str(tree))
    expected = files.unzip(files.read_files(spark, str(tree)).where("path like '%.zip'"))
    assert rows(whole) == rows(expected) and whole.where("error is null").count() == 41 and whole.where("error is not null").count() == 3
    parts = read.option("partition_bytes", "9000").load(str(tree))
    assert 5 <= parts.rdd.getNumPartitions() <= 20 and rows(parts) == rows(whole)
    assert rows(read.option("max_members", "3").load(str(tree)).where("archive like '%big.zip'").select("path", "error")) == ["('', 'archive too large')"]
    inner = files.parse_files(parts.where("error is null").select(F.concat_ws("!", "archive", "path").alias("path"), "content"))
    assert inner.where("error is null").count() == 41


def test_archives_round_trip(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    docs = spark.range(50).selectExpr("concat('d', id % 7, '/n', id % 25, '.txt') as path", "encode(concat('Text ', id), 'UTF-8') as content")
    docs.repartition(3).write.format("archive_members").mode("append").save(out)
    load = lambda: spark.read.format("archive_members").load(out)
    back = load()
    assert back.select("archive").distinct().count() == 3
    assert rows(back.select("content")) == rows(docs.select("content"))
    same = spark.createDataFrame([("a.txt", b"1"), ("a.txt", b"2"), ("b/c", b"3"), ("b/c", None)], "path string, content binary").coalesce(1)
    same.write.format("archive_members").mode("overwrite").save(out)
    assert sorted((r["path"], bytes(r["content"])) for r in load().collect()) == [("a (2).txt", b"2"), ("a.txt", b"1"), ("b/c", b"3"), ("b/c (2)", b"")]
    with pytest.raises(Exception, match="parent folder"):
        same.selectExpr("'../x' as path", "content").write.format("archive_members").mode("overwrite").save(out)
    assert load().count() == 4 and len(list((tmp_path / "out").iterdir())) == 1


def test_export_keeps_to_what_may_be_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "/a/", "x.txt", "eins"), (2, "/b/", "x.txt", "zwei"), (3, "/a/c/", "x.txt", None), (4, "/a/", "y.txt", "vier")], "doc_id long, folder string, file_name string, text string")
    who = Principal("user", False, ("/a/",))
    formats.export_archive(docs, str(tmp_path / "e"), [1, 2, 3], who)
    got = spark.read.format("archive_members").load(str(tmp_path / "e")).collect()
    assert sorted((r["path"], bytes(r["content"])) for r in got) == [("x (2).txt", b""), ("x.txt", b"eins")]
    with pytest.raises(ValueError, match="more than 200"):
        formats.export_archive(docs, str(tmp_path / "e"), list(range(201)), who)
