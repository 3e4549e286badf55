"""The pipeline against its stages one by one, and the stages' operators against plain versions of their methods."""

import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folioweave.llm import decontam, mixing, pii, queries, sharding, simhash, tokens, toxicity
from tests.llm.test_filters import alnum, no_docs, odd_docs, plain_words  # noqa: F401
from tests.llm.test_spans_and_shards import PII, card, luhn, plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):  # noqa: F811
    """Odd rows, copies, a toxic vocabulary and a leaked item, as a folder of tables."""
    rng = random.Random(9)
    d = str(tmp_path_factory.mktemp("tables"))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(100, 400):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(["vile", "rotten", "scum"]) if toxic and rng.random() < 0.4 else word() for _ in range(40))
        rows.append((i, text, "en", f"src{i % 4}", len(text), 0.5, "k", 1))
        labels.append((i, 1, int(toxic)))
    leaked = " ".join(word() for _ in range(30))
    rows += [(500, f"{word()} {leaked} {word()}", "en", "src1", 1, 0.0, "k", 1), (501, rows[1][1], "en", "src2", 1, 0.0, "k", 1), (502, rows[1][1] + " x", "en", "src2", 1, 0.0, "k", 1)]
    odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leaked), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return Counter(map(str, df.select(sorted(df.columns)).collect()))


def test_pipeline_is_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, tables).cache()
        assert after.columns == columns
        mine, theirs = rows_of(after), rows_of(before)
        if name != "mixing":
            assert mine - theirs == Counter()
        if name == "toxicity":
            scored = toxicity.toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet")).where("predicted = 0")
            assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in scored.collect())
            kept = {r["doc_id"] for r in after.collect()}
            assert sum(i in kept for i in range(100, 400, 4)) < 12 and sum(i in kept for i in range(101, 400, 2)) > 145
        elif name.startswith("simhash"):
            found = simhash.near_duplicates(before).collect()
            assert sorted(r["doc_id"] for r in after.collect() if r["doc_id"] is not None) == sorted({r["component_id"] for r in found if r["component_id"] is not None})
        elif name.startswith("benchmark"):
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == {500}
        else:
            times = mixing.mix(before).collect()
            assert Counter(r["doc_id"] for r in after.collect()) == Counter({k: v for k, v in Counter(i for r in times for i in [r["doc_id"]] * r["epochs"]).items() if v})
        before = after
    expected = rows_of(tokens.token_output(before, queries.tokenizer_path()))
    assert rows_of(corpus_pipeline.run(spark, tables)) == expected and sum(expected.values()) > 200


def test_pipeline_of_no_rows(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash(spark):
    rows = [(1, "one two three four", "s", 0.5, 1, 2, "x", "y"), (1, "one two three four", "s", 0.7, 3, 4, "z", "w"), (2, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Score double, kept_id int, mix_takes int, key string, _score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "zz yy")], "item_id long, text string")
    assert rows_of(toxicity.drop_toxic(docs, labels)) == rows_of(docs) == rows_of(decontam.drop_contaminated(docs, items))
    one = simhash.drop_near_duplicates(docs)
    assert one.columns == docs.columns and one.count() == 2 and rows_of(one) == rows_of(simhash.drop_near_duplicates(docs.repartition(3)))
    assert mixing.draw(docs).columns == docs.columns


def test_differencing_against_plain():
    rng = random.Random(4)
    for shards, n in ((2, 9), (3, 14), (7, 40)):
        sizes = [rng.randint(1, 10**6) for _ in range(n)]
        tick = itertools.count()
        heap = [(-x, next(tick), [0] * (shards - 1) + [x]) for x in sizes]  # spread, sums in ascending order
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            both = sorted(x + y for x, y in zip(a, reversed(b), strict=True))
            heapq.heappush(heap, (both[0] - both[-1], next(tick), both))
        sums = np.bincount(sharding.difference(np.array(sizes), shards), sizes, shards)
        assert sorted(sums.tolist()) == heap[0][2]


def test_ftrl_against_plain(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(12)) for _ in range(60)]
    label = [int("aaa bbb" in t) for t in texts]
    sample = spark.createDataFrame([(i, i, t, y) for i, (t, y) in enumerate(zip(texts, label, strict=True))], "doc_id long, order long, text string, label int")
    found = dict(toxicity.fit(sample))
    slots = defaultdict(list)
    for lo, hi, row, slot, count in toxicity.features(pa.array(texts)):
        for r, s, v in zip(row.tolist(), slot.tolist(), toxicity.values(row, count, hi - lo).tolist(), strict=True):
            slots[lo + r].append((s, v))
    z, n, bias = defaultdict(float), defaultdict(float), toxicity.MAX_WEIGHTS - 1

    def weight(s):
        penalty = 0.0 if s == bias else 4.0
        return 0.0 if abs(z[s]) <= penalty else -(z[s] - math.copysign(penalty, z[s])) / (1 + math.sqrt(n[s]))

    for epoch in range(4):
        for i in np.random.default_rng(epoch).permutation(len(texts)).tolist():
            x = [*slots[i], (bias, 1.0)]
            w = {s: weight(s) for s, _ in x}
            error = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x))) - label[i]
            for s, v in x:
                g = error * v * (3.0 if label[i] else 1.0)
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) * w[s]
                n[s] += g * g
    expected = {s: weight(s) for s in z if weight(s)}
    assert found == pytest.approx(expected, rel=1e-6) and len(found) > 3
    # the first rows alone, if there is no room for more features
    few = sum(map(len, list(slots.values())[:20])) + 1
    plain_limit, toxicity.TRAIN_FEATURES = toxicity.TRAIN_FEATURES, few
    try:
        assert toxicity.fit(sample) == toxicity.fit(sample.where("order < 20")) != toxicity.fit(sample)[:0]
    finally:
        toxicity.TRAIN_FEATURES = plain_limit


def brute_context(texts):
    """The added spans of ``find_pii``: a graph of patterns and instances scored in turns."""
    mentions, base = [], []
    for d, text in enumerate(texts):
        base.append([tuple(map(int, s.split(":")[1:])) for s in plain(PII, text)[2]])
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
        for i, (a, b) in enumerate(words):
            if re.search("[0-9@]", text[a:b]):
                instance = re.sub(r"^[^a-z0-9+(]+|[^a-z0-9)]+$", "", text[a:b].lower())
                beside = lambda j: text[slice(*words[j])].lower() if 0 <= j < len(words) else ""  # noqa: B023, E731
                shape = re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", instance))
                patterns = {x for x in (f"l {beside(i - 1)} {shape}" if beside(i - 1) else f"l {shape}", f"r {beside(i + 1)} {shape}" if beside(i + 1) else f"r {shape}")}
                mentions.append((d, a, b, instance, patterns, any(x < b and y > a for x, y in base[d])))
    edges = defaultdict(bool)
    for _, _, _, instance, patterns, seed in mentions:
        for p in patterns if instance else ():
            edges[p, instance] |= seed
    score = defaultdict(float)
    for (_, i), seed in edges.items():
        score[i] = max(score[i], float(seed))
    accepted = -1
    while (now := sum(s >= pii.ACCEPT for s in score.values())) != accepted:
        accepted = now
        of = defaultdict(list)
        for p, i in edges:
            of[p].append(score[i])
        sure = {p: sum(s) / len(s) for p, s in of.items() if sum(s) / len(s) >= pii.CONFIDENT and sum(x >= pii.ACCEPT for x in s) >= pii.SUPPORT}
        doubt = defaultdict(lambda: 1.0)
        for (p, i), seed in edges.items():
            if not seed and p in sure:
                doubt[i] *= 1 - min(sure[p], 0.999)
        for i, x in doubt.items():
            score[i] = max(score[i], 1 - x)
    return {(d, a, b) for d, a, b, i, _, seed in mentions if not seed and i and score[i] >= pii.ACCEPT}


def test_added_spans_against_a_plain_graph(spark):
    rng = random.Random(5)
    far = " " * 200 + "y" * 120  # blanks and words longer than any window
    good = lambda: card("".join(rng.choices("123456789", k=15)))
    wrong = [x for x in ("".join(rng.choices("123456789", k=16)) for _ in range(30)) if not luhn(x)][:6]
    texts = [f"account{far} {good()}{far} holder" for _ in range(6)] + [f"account{far} {w}{far} holder" for w in wrong[:4]]
    # a pattern that only found identifiers support finds another one in the next turn
    texts += [f"see {w} there" for w in wrong[:5]] + [f"account{far}z {wrong[5]}{far}z holder", f"account{far} {wrong[5][:-1]}{far} holder", "year 2020 and 2021, (b4) 7", "", "no digits"]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r["doc_id"], s["start"], s["end"]) for r in found for s in r["spans"] if s["kind"] == "context"}
    assert got == brute_context(texts) and {d for d, _, _ in got} == {*range(6, 15)}


def test_texts_longer_than_a_slice(spark):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abcdefghé'") for _ in range(rng.randint(1, 8))) for _ in range(150_000))
    tail = " ".join(long.split()[-40:])
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, long + " mail a@b.cd AKIA" + "A1" * 9)], "doc_id long, text string")
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokens.token_output(docs, queries.tokenizer_path()).collect()}
    for r in docs.collect():
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 0]
        assert got[r["doc_id"]] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    found = decontam.contained(docs, spark.createDataFrame([(1, tail), (2, "zz zz")], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (3, 1)} and len(alnum(tail)) > 5
    labels = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert labels[3]["component_id"] == 1 and len(plain_words(long)) == 150_000
    spans = {r["doc_id"]: r["base"] for r in pii.find_pii(docs).collect()}
    assert [(s["kind"], s["start"]) for s in spans[3]] == [("email", len(long) + 6)] and not spans[1]
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert set(scores.values()) == {0.5}
