"""Repeated byte strings against a table of all windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioweave.llm import substrings
from tests.llm.test_filters import no_docs, odd_docs  # noqa: F401

LENGTH = substrings.LENGTH


def brute(texts):
    count = Counter()
    for t in texts:
        count.update(t[i : i + LENGTH] for i in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - LENGTH + 1):
            if count[t[i : i + LENGTH]] > 1:
                gone[i] += 1
                gone[i + LENGTH] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def planted(rng):
    line = lambda n: "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))
    shared = [line(n) for n in (396, 399, 400, 401, 450, 900, 3000)]
    docs = [line(rng.randint(0, 900)) + rng.choice(shared) + line(rng.randint(0, 900)) for _ in range(120)]
    docs += [line(50) + shared[4] + line(30) + shared[4] + line(20), "x" * 1500, "ab" * 900, (line(90) + "\n") * 12, "x" * 400, "x" * 399, shared[6], shared[6], shared[6][:-1] + "!", "!" + shared[6][1:]]
    for _ in range(40):  # near copies: other contexts around the same anchors
        t = list(shared[6])
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = "Z"
        docs.append("".join(t))
    return docs


def check(spark, docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    expected = Counter((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    found = substrings.remove_repeats(docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found) == expected
    assert all(r["longest"] >= LENGTH for r in found if r["n_removed"]) and all(r["longest"] == 0 or r["longest"] >= substrings.SHORT for r in found)


def test_against_all_windows(spark, odd_docs, no_docs):  # noqa: F811
    texts = planted(random.Random(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(spark, docs)
    check(spark, odd_docs)
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert substrings.remove_repeats(no_docs).count() == 0


def test_large_groups_are_dealt_again(spark, monkeypatch):
    """Groups of more than ``GROUP`` contexts, and parts of more, give what all windows give."""
    rng = random.Random(6)
    line = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    common, short = line(420), line(380)
    texts = planted(rng) + [line(500) + common + line(500) for _ in range(30)] + [line(500) + short + line(500) for _ in range(30)] + [line(9) + short + line(30) for _ in range(9)]
    texts += [common[:200] + line(3) + short + x + "tail" * 9 for x in ("a", "b") for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (2, 12):
        monkeypatch.setattr(substrings, "GROUP", group)
        check(spark, docs)


def test_shorter_passages_are_known(spark):
    rng = random.Random(10)
    line = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    shared = [line(n) for n in (320, 340, 370, 390)]
    texts = [line(rng.randint(300, 900)) + shared[i % 4] + line(rng.randint(300, 900)) for i in range(60)] + [line(rng.randint(300, 2000)) for _ in range(60)]
    texts += [line(500) + shared[0][:200] + line(500) for _ in range(9)]
    rows = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    longest = {r["doc_id"]: r["longest"] for r in rows}
    assert sum(longest[i] >= 300 for i in range(60)) >= 54 and not any(longest[i] for i in range(60, 129))
    assert all(longest[i] <= len(shared[i % 4]) + 3 for i in range(60)) and not any(r["n_removed"] for r in rows)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefghij klmnopé") for _ in range(n))
    shared = [line(n) for n in (400, 900, 5000)]
    long = "".join(line(rng.randint(0, 3000)) + rng.choice(shared) for _ in range(60))
    column = pa.array([long, "short", None, long[5:], line(3000) + shared[1]])
    monkeypatch.setattr(substrings.kernel, "SLICE_BYTES", 7000)
    windows = Counter()
    for row, data, offsets, at in substrings.chunks(column):
        r, first, last, anchor, gram = substrings.anchors(data, offsets)
        for a, i, j in zip((row + r).tolist(), (at + first - offsets[r]).tolist(), (at + last - offsets[r]).tolist(), strict=True):
            windows.update((a, k) for k in range(i, j + 1))
    sizes = [len((x or "").encode()) for x in column.to_pylist()]
    assert windows == Counter((i, k) for i, n in enumerate(sizes) for k in range(n - LENGTH + 1))


def test_suffix_sort_against_sorted():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 2900, 400))
    ends = np.minimum(starts + rng.integers(1, 300, 400), 3000)
    group = np.sort(rng.integers(0, 9, 400))
    order, shared = substrings.suffix_sort(text, substrings.Prefixes(text), starts, ends, group)
    suffix = [text[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert [(group[i], suffix[i]) for i in order] == sorted((g, s) for g, s in zip(group, suffix, strict=True))
    for k in range(1, 400):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert shared[k] == (same if group[order[k]] == group[order[k - 1]] else 0)


def test_prefix_hashes_against_integers():
    rng = np.random.default_rng(5)
    data, prime = rng.integers(0, 256, 700).astype(np.uint8), (1 << 61) - 1
    for base in substrings.BASES:
        hashes = substrings.Prefixes(data, base)
        for a, b in rng.integers(0, 700, (40, 2)).tolist():
            a, b = min(a, b), max(a, b)
            plain = sum((int(c) + 1) * pow(base, i, prime) for i, c in enumerate(data[a:b].tolist())) * pow(base, substrings.LONGEST, prime) % prime
            assert int(hashes.spans(np.array([a]), np.array([b]))[0]) == plain


def test_collisions_are_seen(monkeypatch):
    data = np.frombuffer(b"abcabd", np.uint8)
    substrings.verify(data, np.array([0]), np.array([3]), np.array([2]))
    with pytest.raises(substrings.Collision):
        substrings.verify(data, np.array([0]), np.array([3]), np.array([3]))
    # a base of zero makes strings of one first byte equal; the next base finds what is right
    rng = random.Random(1)
    line = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    content = [line(20) + b"x" * 48 + line(500) for _ in range(6)]
    content[3] = line(3) + content[1][3:]
    arguments = content, np.full(6, 20), np.array([len(x) - LENGTH + 1 for x in content]), np.zeros(6, np.int64)
    right, _ = substrings.repeated_windows(*arguments)
    assert right.any() and not right.all()
    tried = []
    plain = substrings.Prefixes
    monkeypatch.setattr(substrings, "Prefixes", lambda data, base: tried.append(base) or plain(data, base))
    monkeypatch.setattr(substrings, "BASES", (0, *substrings.BASES[:1]))
    assert (substrings.repeated_windows(*arguments)[0] == right).all() and len(tried) == 2
    monkeypatch.setattr(substrings, "BASES", (0,))
    with pytest.raises(RuntimeError):
        substrings.repeated_windows(*arguments)
