"""Toxicity, SimHash, decontamination, mixing and token output against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from folioweave.llm import decontam, kernel, mixing, simhash, tokens, toxicity
from folioweave.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, component_id long"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    base = [" ".join(word(rng) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t), 0.0, "k", 1) for i, t in enumerate(base)]
    rows += [(40, None, None, None, None, None, None, None), (41, "", "en", "src0", 0, 0.0, "k", 1), (None, base[3], None, None, 1, 0.1, "k", 2), (None, "a b c d", None, "src1", 1, 0.1, "k", 2)]
    rows += [rows[5], rows[5], (42, base[7] + " x", "en", "src1", 3, 0.0, "k", 1), (43, "Ünï çödé   中文 \U0001f600 it's  fine\n\n", "en", "src9", 1, 0.0, "k", 1)]
    rows += [(44, " ".join(word(rng) for _ in range(9000)), "en", None, 1, 0.0, "k", 1), (45, " \t\n ", "en", "src0", 3, 0.0, "k", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(simhash._LOWER))


def test_simhash_components_against_all_pairs(spark, odd_docs):
    def print_of(text):
        w = plain_words(text)
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for docs in (odd_docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = [(r["doc_id"], print_of(r["text"])) for r in docs.collect()]
        root = list(range(len(rows)))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if (a[1] ^ b[1]).bit_count() <= 3:
                    root[find(i)] = find(j)
        least = defaultdict(list)
        for i, r in enumerate(rows):
            least[find(i)] += [r[0]] if r[0] is not None else []
        expected = sorted((str(r[0]), f"{r[1]:016x}", str(min(least[find(i)], default=None))) for i, r in enumerate(rows))
        assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect()) == expected


def test_simhash_covering_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for mask in [simhash.OUTER, *simhash.INNER]:
        pass
    for _ in range(500):
        bits = rng.choice(64, 3, replace=False)
        diff = sum(1 << int(b) for b in bits)
        free = [t for t, m in enumerate(simhash.OUTER) if not m & diff]
        assert free and all(any(not m & diff for m in simhash.INNER[t]) for t in free)
    center = int(rng.integers(0, 1 << 62))
    prints = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(300)}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    signed = [simhash._signed(x) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def roots(edges):
        return {r["node"]: r["root"] for r in simhash.components(edges).collect()}

    expected = roots(simhash.links(df))
    monkeypatch.setattr(simhash, "BUCKET", 8)
    assert roots(simhash.links(df)) == expected
    near = [(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert roots(spark.createDataFrame(near, "src long, dst long")) == expected


def test_simhash_keeps_one_of_each(spark, odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    labels = simhash.near_duplicates(odd_docs).collect()
    named = {r["component_id"] for r in labels if r["component_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(named)
    assert ids.count(None) == len({r["fingerprint"] for r in labels if r["component_id"] is None})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def alnum(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", folded)


def test_decontamination_against_counting(spark, odd_docs, no_docs, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rng = random.Random(1)
    own = [(r["item_id"], r["text"]) for r in items.collect()]
    for k in range(60):  # passages with words changed, between none and too many
        w = texts[k][1].split()[:40]
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zzz"
        own.append((1000 + k, " ".join(w)))
    own += [(2000, None), (2001, ""), (2002, "one two three"), (2003, " ".join(alnum(texts[3][1])[4:7])), (2004, texts[4][1].split()[9] + "!"), (2005, " ".join(alnum(texts[5][1])[:4]))]
    grams = lambda t, k: {tuple(w[i : i + k]) for w in [alnum(t)] for i in range(len(w) - k + 1)}
    width = {i: min(5, len(alnum(t))) for i, t in own}
    held = {i: grams(t, width[i]) for i, t in own if width[i]}
    expected = set()
    for d, t in texts:
        g = {k: grams(t, k) for k in range(1, 6)}
        expected |= {(d, i, len(h), len(h & g[width[i]])) for i, h in held.items() if len(h & g[width[i]]) >= 0.8 * len(h) - 1e-9}
    assert {2003, 2004, 2005} <= {e[1] for e in expected}
    found = decontam.contained(docs, spark.createDataFrame(own, "item_id long, text string"))
    assert {(r[0], r[1], r[2], r[3]) for r in found.collect()} == expected and len(expected) > 30
    clean = decontam.drop_contaminated(docs, spark.createDataFrame(own, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in texts} - {e[0] for e in expected}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    found = decontam.contained(docs, spark.createDataFrame(own, "item_id long, text string"))
    assert {(r[0], r[1], r[2], r[3]) for r in found.collect()} == expected
    assert decontam.contained(no_docs, items).count() == 0 and decontam.drop_contaminated(odd_docs, items).count() == odd_docs.count()
    assert decontam.contained(odd_docs, items.limit(0)).count() == 0


def test_mixing_targets_and_takes(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        size, target, taken = defaultdict(int), {}, defaultdict(int)
        for r in rows:
            size[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 2 * r["size"]
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        share, open_, total = {s: 0.0 for s in order}, set(order), 1.5 * sum(size.values())
        capped: dict = {}
        while open_:
            level = (total - sum(capped.values())) / sum(weight[s] for s in open_)
            over = {s for s in open_ if level * weight[s] > 2 * size[s]}
            if not over:
                share = capped | {s: level * weight[s] for s in open_}
                break
            capped |= {s: 2.0 * size[s] for s in over}
            open_ -= over
        longest = defaultdict(int)
        for r in rows:
            longest[r["source"]] = max(longest[r["source"]], r["size"])
        for s in order:
            assert target[s] == pytest.approx(share[s]) and r["source_size"] is not None
            assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1
        assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, rows))
        drawn = mixing.draw(docs)
        assert drawn.columns == docs.columns
        words = drawn.select(mixing.word_count(drawn["text"]).alias("n")).agg({"n": "sum"}).first()[0]
        assert words == sum(taken.values())
    assert mixing.mix(no_docs).count() == 0 and mixing.draw(no_docs).count() == 0


def test_mixing_prefers_quality(spark):
    docs = spark.createDataFrame([(i, "word " * 10 + ("" if i % 2 else "#$%&" * 40), "t") for i in range(4000)], "doc_id long, text string, source string")
    rows = [r for r in mixing.mix(docs).collect() if r["source"] == "t"]
    odd, even = (sum(r["epochs"] for r in rows if r["doc_id"] % 2 == k) for k in (1, 0))
    assert odd > 1.05 * even


def test_numbers_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = rng.integers(0, 2 ** rng.integers(1, 33, n), dtype=np.uint64).astype(np.uint32) if n else np.zeros(0, np.uint32)
        assert (tokens.decode_numbers(tokens.encode_numbers(x), n) == x).all()


def test_tokens_against_the_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    for docs in (odd_docs, spark.read.parquet(f"{DATA}/documents.parquet")):
        rows = docs.collect()
        found = sorted(tokens.token_output(docs, tokenizer_path()).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
        at = 0
        own = defaultdict(list)
        for r in rows:
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            own[r["doc_id"]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        got = defaultdict(list)
        for r in found:
            assert r["start"] == at
            at += r["n_tokens"]
            got[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in own.items()} == {k: sorted(v) for k, v in got.items()}
    assert tokens.token_output(no_docs, tokenizer_path()).count() == 0


def test_toxicity_learns_and_generalises(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    held = [(r["score"], label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = ([s for s, y, _ in held if y == k] for k in (0, 1))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.93
    hits = [y for _, y, p in held if p]
    assert np.mean(hits) > 0.85 and sum(hits) > 0.5 * len(bad)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    odd = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len(odd) == odd_docs.count() and {r["score"] for r in odd} == {0.5}
    assert toxicity.toxicity(no_docs, labels.limit(50)).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_large_items_are_held_against_few_hashes():
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    items = decontam.Items([(i, text(n).encode()) for i, n in enumerate([12] * 60 + [600] * 60)], decontam.CONTAINMENT)
    docs = [text(2000).encode() for _ in range(20)]
    docs[3] += b" " + items.text[items.end[70] : items.end[71]]
    data, ends = np.frombuffer(b"".join(docs), np.uint8), np.append(0, np.cumsum([len(x) for x in docs]))
    found = items.candidates(*kernel.word_hashes(data, ends, kernel.ALNUM)).tolist()
    read = {p.size: p.read for p in items.partitions}
    assert [3, 70] in found and set(read) == {8, 1024} and read[1024] < 0.6 * read[8]


def test_names_in_another_case(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "quite another text of some words here")], "doc_id long, Text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(docs, labels, 1.1).columns == docs.columns
