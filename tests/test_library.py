"""Literal cases of keys, access, ranking, versions, graph and upkeep."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.functions import folders as A
from folioweave.functions import text as T
from folioweave.operators import chunking, filters, graph, listing, maintenance, retrieval
from folioweave.sources import files


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize("composed", [True, False])
def test_norm_keys(spark, composed):
    cases = {
        "ÖNORM B 1801-1": ("önorm_b_1801_1", None), "OENORM B1801-1:2022": ("önorm_b_1801_1", "2022"), "onorm b 1801-2": ("önorm_b_1801_2", None), "EN 1992": ("en_1992", None), "ISO 9001": ("iso_9001", None),
        "DIN EN ISO 9001 (2015)": ("din_en_iso_9001", "2015"), "EN 1990 Ausgabe 2013": ("en_1990", "2013"), "EN 1990: 2013": ("en_1990_2013", None),
    }
    assert column(spark, cases, lambda v: T.norm_key(v, composed)) == [k for k, _ in cases.values()]
    assert column(spark, cases, T.norm_version) == [y for _, y in cases.values()]


def test_other_keys_and_ids(spark):
    assert column(spark, ["§ 12", "§§ 12", "§12a", "Art. 17", "Artikel 17", "Art 17"], T.legal_key) == ["par_12", "par_12", "par_12a", "art_17", "art_17", "art_17"]
    once = column(spark, ["Straße  Größe!", "ﬁnal--Test_", "  ", None], T.normalize_key)
    assert once == ["strasse_grösse", "final_test", "", None] and column(spark, once, T.normalize_key) == once
    assert column(spark, ["hello"], lambda v: T.chunk_id(F.lit("d1"), F.lit(None).cast("string"), v)) == ["88bd3f70161f26dd3f20c385b025895660736de1"]
    assert column(spark, ["1.2 Titel", "3) x", "Titel"], T.numbering_level) == [2, 1, None]
    assert column(spark, ["Ausgabe 2013-05", "x"], T.version_year) == [2013, None]


def test_references(spark):
    text = "Gemäß ÖNORM B 1801-1:2022 und önorm b1801-1 sowie DIN EN ISO 9001; siehe § 16 und Art. 17."
    assert column(spark, [text], T.references) == [["norm:önorm_b_1801_1", "norm:din_en_iso_9001", "legal:par_16", "legal:art_17"]]
    found = column(spark, [text, "publié en 2020"], T.norm_matches)
    assert [(m["key"], m["version"]) for m in found[0]] == [("önorm_b_1801_1", "2022"), ("önorm_b_1801_1", None), ("din_en_iso_9001", None)]
    assert [m["key"] for m in found[1]] == ["en_2020"]


def test_access(spark):
    assert column(spark, ["Steuer", "", "//a//b", None], A.normalize_folder) == ["/Steuer/", "/", "/a/b/", "/"]
    for allowed, folder, key, user in [([], "/Bau/", True, False), (["/Steuer"], "/Steuer/2024/", True, True), (["/Steuer"], "/Steuer2025-Neukunde/", False, False), (["/"], "/Bau/", True, True)]:
        df = spark.createDataFrame([(folder,)], "folder string")
        arr = F.array(*[F.lit(a) for a in allowed]).cast("array<string>")
        got = df.select(A.key_allows(F.col("folder"), arr), A.user_allows(F.col("folder"), F.lit(False), arr)).first()
        assert tuple(got) == (key, user)
        assert A.restrict(df, A.Principal("key", False, tuple(allowed))).count() == key and A.restrict(df, A.Principal("user", False, tuple(allowed))).count() == user
    admin, reader = A.Principal("user", role="admin"), A.Principal("user")
    assert admin.has_scope("write") and reader.has_scope("read") and not reader.has_scope("write")
    with pytest.raises(ValueError):
        filters.compile_filter({"field": "a", "operator": "~", "value": 1})


def test_fusion_budget_and_citation(spark):
    ranked = lambda ids: spark.createDataFrame([(c, i + 1) for i, c in enumerate(ids)], "chunk_id string, rank int")
    fused = {r[0]: r[1] for r in retrieval.fuse(ranked(["c1", "c2", "c3"]), ranked(["c3", "c1", "c4"])).collect()}
    assert fused == pytest.approx({"c1": 0.032522, "c3": 0.032266, "c2": 0.016129, "c4": 0.015873}, abs=1e-6)
    rows = spark.createDataFrame([(d, i) for i, d in enumerate("abacb")], "doc_id string, rank int")
    assert [r[0] for r in filters.content_budget(rows, 2).orderBy("rank").collect()] == list("abab")
    assert filters.content_budget(rows, 0).count() == 5
    cited = spark.createDataFrame([("a.pdf", 12, "6 › 6.2", "x"), ("a.pdf", None, None, None)], "file_name string, page int, section_path string, section_title string")
    assert [r["citation"] for r in filters.with_citation(cited).collect()] == ["a.pdf, S. 12, 6 › 6.2", "a.pdf"]


def test_versions_and_jobs(spark):
    docs = spark.createDataFrame([(1, "n", "2010"), (2, "n", "2018"), (3, "n", "2022"), (4, "n", None), (5, None, "2001")], "doc_id long, norm_key string, doc_version string")
    got = {r["doc_id"]: (r["valid_status"], r["superseded_by"]) for r in listing.version_status(docs).collect()}
    assert got == {1: ("superseded", 3), 2: ("superseded", 3), 3: ("current", None), 4: ("unknown", None), 5: ("unknown", None)}
    states = {"partial": ["done", "done", "failed"], "failed": ["failed", "failed"], "running": ["done", "queued"], "done": ["done", "done"]}
    queue = spark.createDataFrame([(j, s) for j, files_ in states.items() for s in files_], "job_id string, status string").selectExpr("*", "cast(null as string) error_msg", "'/' folder", "timestamp '2024-01-01' created_at", "cast(null as timestamp) finished_at")
    assert {r["job_id"]: r["status"] for r in listing.job_status(queue).collect()} == {k: k for k in states}


def test_pagerank_and_participation(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_key string")
    edges = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 1.0)], "src_key string, tgt_key string, w_eff double")
    got = {r[0]: r[1] for r in graph.pagerank(nodes, edges).collect()}
    assert got == pytest.approx({"a": 0.212766, "b": 0.212766, "c": 0.574468}, abs=1e-6)
    members = spark.createDataFrame([("x", 0), ("p", 0), ("q", 1), ("lonely", 0)], "node_key string, community_id int")
    links = spark.createDataFrame([("x", "p", 2.0), ("q", "x", 2.0)], "src_key string, tgt_key string, w_eff double")
    assert {r[0]: r[1] for r in graph.participation(members, links).collect()} == {"x": 0.5, "p": 0.0, "q": 0.0, "lonely": 0.0}
    marks = graph.describe_communities(spark.createDataFrame([("a", 1), ("b", 1)], "node_key string, community_id int"), spark.createDataFrame([("a", 0.1), ("b", 0.9)], "node_key string, pagerank double")).first()
    assert marks["member_fingerprint"] == "687d61996b1c1278c973743efe7ee8e2fc8fb1d0"


def test_communities_of_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1.0)]
    edges = spark.createDataFrame(pairs, "src_key string, tgt_key string, w_eff double")
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "ab" for i in range(5)] + [("z",)], "node_key string")
    found = graph.communities(nodes, edges)
    by = {r[0]: r[1] for r in found.collect()}
    assert len({by[f"a{i}"] for i in range(5)}) == 1 and len({by[f"b{i}"] for i in range(5)}) == 1 and by["a1"] != by["b1"] and by["z"] == "z"
    assert graph.modularity(found, edges) > 0.4


def test_shingles_and_near_duplicates(spark):
    a = "the quick brown fox jumps over the lazy dog again"
    texts = [a, a.replace("dog", "cat"), "three word text", "", None]
    sets = column(spark, texts[:4], graph.shingles)
    assert (len(set(sets[0]) & set(sets[1])), len(set(sets[0]) | set(sets[1])), len(sets[2]), sets[3]) == (4, 8, 1, [])
    long = [" ".join(f"w{(i * k) % 997}" for i in range(300)) for k in (3, 5, 7)]
    long.append(long[0].replace("w30 ", "zz "))
    docs = spark.createDataFrame(list(enumerate(texts[:3] + long)), "id long, text string")
    rows = {(r["src"], r["dst"]): r["jaccard"] for r in graph.similar_texts(docs).collect()}
    s = [set(x) for x in column(spark, texts[:3] + long, graph.shingles)]
    expected = {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for j in range(len(s)) for i in range(j)}
    assert rows == pytest.approx({k: v for k, v in expected.items() if v >= 0.8}) and rows
    found = graph.near_duplicates(docs.withColumnRenamed("id", "doc_id")).collect()
    assert {(r["src"], r["dst"]) for r in found} == set(rows)


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "abcdefghijkl " * 3 + "house " * 4 + "single")], "doc_id long, text string")
    assert [(r["word"], round(r["score"], 6)) for r in listing.keywords(docs).orderBy("rank").collect()] == [("house", 5.0), ("abcdefghijkl", 4.8)]


def test_tags(spark):
    tags = ["vertrag"] * 5 + ["vertrage"] * 2 + ["din", "iso", "en", "a", "b"]
    docs = spark.createDataFrame([(i, [t]) for i, t in enumerate(tags)], "doc_id long, tags array<string>")
    counts = maintenance.tag_counts(docs)
    pairs = {(r["a"], r["b"]): r["distance"] for r in maintenance.near_tags(counts).collect()}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [last := i] + [last := min(last + 1, row[j] + 1, row[j - 1] + (c != d)) for j, d in enumerate(y, 1)]
        return row[-1]

    words = sorted(set(tags))
    assert pairs == {(a, b): distance(a, b) for a in words for b in words if a < b and distance(a, b) <= 2}
    assert ("din", "iso") not in pairs and ("din", "en") in pairs
    merges = maintenance.tag_merges(counts)
    assert ("vertrag", "vertrage") in {tuple(r) for r in merges.collect()}
    merged = maintenance.apply_merges(docs, merges)
    assert merged.where("array_contains(tags, 'vertrage')").count() == 0
    back = maintenance.undo_merge(merged, "vertrag", "vertrage", [5, 6])
    assert back.where("array_contains(tags, 'vertrage')").count() == 2
    assert maintenance.merge_journal(docs, merges, F.lit("2024-01-01").cast("timestamp")).where("summary like \"Tag 'vertrage'%\"").count() == 1


def test_tag_merges_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    n = {"".join(rng.choice("ab") for _ in range(rng.randint(3, 6))): rng.randint(1, 4) for _ in range(18)}

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [last := i] + [last := min(last + 1, row[j] + 1, row[j - 1] + (c != d)) for j, d in enumerate(y, 1)]
        return row[-1]

    gone, expected = set(), []
    for a in sorted(n):  # tag by tag, as the survey has it
        for b in sorted(b for b in n if b > a and distance(a, b) <= 1) if a not in gone else []:
            winner, loser = (a, b) if n[a] >= n[b] else (b, a)
            if b not in gone and loser not in gone:
                expected.append((winner, loser))
                gone.add(loser)
    counts = spark.createDataFrame(list(n.items()), "tag string, n long")
    plain = maintenance.near_tags
    monkeypatch.setattr(maintenance, "near_tags", lambda c: plain(c, 1))
    one_by_one = {tuple(r) for r in maintenance.tag_merges(counts).collect()}
    monkeypatch.setattr(maintenance, "DRIVER_PAIRS", 0)
    assert {tuple(r) for r in maintenance.tag_merges(counts).collect()} == one_by_one == set(expected) and len(expected) > 3


def test_zip_members(spark):
    assert column(spark, ["BVH/Plaene/x.pdf", "x.pdf"], lambda v: A.zip_folder(v, F.lit("/Steuer/"))) == ["/Steuer/BVH/Plaene/", "/Steuer/"]
    assert [bool(files.member_problem(n)) for n in ("/etc/x", "C:x", "../x", "a/b.txt")] == [True, True, True, False]
    assert files.member_problem("link", 0o120777)


def test_chunks(spark):
    assert chunking.breadcrumbs([("A", 1), ("B", 2), ("leaf", None), (None, None), ("C", 1)]) == ["A", "A › B", "A › B › leaf", "A › B", "C"]
    parts = chunking.packed(["a" * 40, "b" * 40, "c" * 40], 90, 45)
    assert parts == ["a" * 40 + "\n" + "b" * 40, "b" * 40 + "\n" + "c" * 40]
    rng = random.Random(7)
    for _ in range(300):  # against taking units one by one
        units = ["u" * rng.randint(1, 40) for _ in range(rng.randint(0, 30))]
        most, overlap = rng.randint(1, 90), rng.randint(0, 60)
        expected, at, repeated = [], 0, []
        while at < len(units):
            chunk, room = [*repeated, units[at]], most - sum(map(len, repeated)) - len(units[at]) - 1
            at += 1
            while at < len(units) and len(units[at]) + 1 <= room:
                room -= len(units[at]) + 1
                chunk.append(units[at])
                at += 1
            expected.append("\n".join(chunk))
            repeated = next(chunk[i:] for i in range(len(chunk) + 1) if sum(map(len, chunk[i:])) <= overlap)
        assert chunking.packed(units, most, overlap) == expected
    assert column(spark, ["Bau-\nwerk und\nmehr  da"], T.repair_layout) == ["Bauwerk und mehr da"]
    assert column(spark, ["x" * 25, "Kurz. \n\n" + "Eins zwei. Drei vier!", ""], lambda v: T.units(v, 10)) == [["x" * 10, "x" * 10, "x" * 5], ["Kurz.", "Eins zwei.", "Drei vier!"], []]
    kids = spark.createDataFrame([("d", i, p, t) for i, (p, t) in enumerate([("s", 600), ("s", 400), ("s", 100), ("t", 5)])], "doc_id string, ordinal int, section_path string, tokens int")
    assert [r["parent"] for r in chunking.assign_parents(kids).orderBy("ordinal").collect()] == [0, 0, 1, 2]
