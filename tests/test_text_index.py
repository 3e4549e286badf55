"""The kept index: upkeep equals an index made anew, under filters and with blocks left out."""

import random

import pytest

from folioweave.operators import retrieval, text_index
from folioweave.operators.text_index import TextIndex

SCHEMA = "chunk_id string, folder string, language string, text string"
ASKED = ["alpha", "beta", "w7", "Nowhere"]
FILTERS = {"all": lambda df: df, "folder": lambda df: df.where("folder = '/a/'"), "language": lambda df: df.where("language is null or folder = '/b/'"), "none": lambda df: df.where("false")}


def chunks(first, n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(first, first + n):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)) + ["alpha"] * rng.choice([0, 0, 1, 5]) + ["Beta"] * (i % 3 == 0))
        out.append((f"c{i:05}", f"/{rng.choice('abb')}/", rng.choice(["de", "en", None]), None if i % 41 == 0 else text))
    return out


def ranked(index, keep, k=12):
    return [tuple(r) for r in index.best(sorted(x.lower() for x in ASKED), k, keep).orderBy("rank").collect()]


def plain(spark, rows, keep, k=12):
    own = keep(spark.createDataFrame(rows, SCHEMA))
    return [tuple(r) for r in retrieval.bm25(own, " ".join(ASKED), k).orderBy("rank").collect()]


def open_index(spark, path):
    return TextIndex(spark, str(path), by=("folder", "language"), buckets=5)


def test_upkeep_equals_an_index_made_anew(spark, tmp_path):
    index = open_index(spark, tmp_path / "i")
    own = {r[0]: r for r in chunks(0, 60, 1)}
    index.write(spark.createDataFrame(list(own.values()), SCHEMA))
    for turn in range(2):
        batch = chunks(50 + 40 * turn, 40, 2 + turn)  # ten of them replace older texts
        index.append(spark.createDataFrame(batch, SCHEMA))
        own |= {r[0]: r for r in batch}
    gone = [f"c{i:05}" for i in range(0, 130, 9)] + ["unknown"]
    index.delete(spark.createDataFrame([(x,) for x in gone], "chunk_id string"))
    own = {k: v for k, v in own.items() if k not in gone}
    expected = {name: plain(spark, list(own.values()), keep) for name, keep in FILTERS.items()}
    assert {name: ranked(index, keep) for name, keep in FILTERS.items()} == expected and expected["none"] == [] != expected["folder"]
    assert {r["chunk_id"] for r in index.texts().collect()} == set(own)
    assert len(index.segments()) == 3 and index.merge(4) == []
    replaced = index.merge(3)
    index.vacuum()
    assert len(replaced) == 3 and len(index.segments()) == 1 and index.segments()[0]["texts"] == len(own)
    assert {name: ranked(index, keep) for name, keep in FILTERS.items()} == expected
    again = list(own.values())[:1]  # a text that was deleted may come back
    index.append(spark.createDataFrame([("c00000", "/a/", "de", "alpha alpha w7")], SCHEMA))
    own["c00000"] = ("c00000", "/a/", "de", "alpha alpha w7")
    assert ranked(index, FILTERS["all"]) == plain(spark, list(own.values()), FILTERS["all"]) and again


@pytest.mark.parametrize("name", ["all", "folder"])
def test_blocks_left_out_change_nothing(spark, tmp_path, monkeypatch, name):
    index = open_index(spark, tmp_path / "i")
    rows = chunks(0, 400, 5)
    index.write(spark.createDataFrame(rows, SCHEMA))
    index.delete(spark.createDataFrame([("c00003",), ("c00007",)], "chunk_id string"))
    rows = [r for r in rows if r[0] not in ("c00003", "c00007")]
    monkeypatch.setattr(text_index, "DIRECT", 0)
    monkeypatch.setattr(text_index, "LEADERS", 4)
    opened = []
    own = TextIndex._opened

    def counted(self, blocks, *more):
        out = own(self, blocks, *more)
        opened.append((out.count(), blocks.select("segment", *self._block()).distinct().count()))
        return out

    monkeypatch.setattr(TextIndex, "_opened", counted)
    assert ranked(index, FILTERS[name], 5) == plain(spark, rows, FILTERS[name], 5)
    assert opened[0][0] < opened[0][1] or name != "all"  # some blocks are never read


def test_index_of_nothing(spark, tmp_path):
    index = open_index(spark, tmp_path / "i")
    with pytest.raises(ValueError, match="no index"):
        index.best(["alpha"], 3)
    index.append(spark.createDataFrame([], SCHEMA))
    assert ranked(index, FILTERS["all"]) == []
    index.append(spark.createDataFrame([("a", "/a/", "de", None), ("b", "/a/", "de", ""), ("c", "/a/", "de", "Alpha")], SCHEMA))
    assert [r[0] for r in ranked(index, FILTERS["all"])] == ["c"]


def test_single_questions_build_no_index(spark, monkeypatch):
    """A registered question over a folder reads its texts once; only ``bm25_index_topk`` builds an index."""
    from folioweave import catalog

    monkeypatch.setattr(catalog, "_INDEXES", {})
    for name in ("content_budget", "retrieve", "hybrid_rrf", "hybrid_acl", "restricted_search"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert not catalog._INDEXES, name


def test_an_index_is_built_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """No task has all postings or blocks of a bucket; equal words, nulls and texts without words count as before."""
    monkeypatch.setattr(text_index, "DEALT", 100)
    rows = [(f"k{i}", "a b" if i % 3 else f"a x{i} é_é a {'w ' * (i % 5)}") for i in range(600)] + [("none", None), ("empty", "--")]
    index = text_index.TextIndex(spark, f"file://{tmp_path}/i", buckets=2).write(spark.createDataFrame(rows, "chunk_id string, text string").repartition(3))
    found = retrieval.bm25(spark.createDataFrame(rows, "chunk_id string, text string"), "a é w x3", 50)
    assert index.best(["a", "w", "x3", "é"], 50).collect() == found.collect()
    for name in ("postings", "blocks"):
        files = list((tmp_path / "i" / name).rglob("part-*.parquet"))
        sizes = [spark.read.parquet(str(f)).count() for f in files]
        assert max(sizes) < sum(sizes) / 2 and len({f.name.split("-")[1] for f in files}) == len(files), name
