"""Hard negatives and vector codes against plain loops, on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from folioweave.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q string, score double, code string"


def table(spark, rows):
    """Rows with other columns whose names clash with those inside."""
    return spark.createDataFrame([(*r, "x", 0.5, "zz") for r in rows], SCHEMA)


def odd_rows(n, width=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(100, rows[0][1], rows[0][2]), (n + 1, None, 1), (n + 2, [0.1, None, *[0.0] * (width - 2)], 1), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] * width, 1), (n + 5, [0.2] * width, None)]
    rows += [(None, [0.25] * width, 1), (n + 6, [0.25] * (width - 3), 2), (n + 7, [], 0), (7 * n, [0.0] * width, 9), (n + 8, rows[5][1], rows[5][2]), (n + 8, rows[5][1], rows[5][2])]
    return rows


def kept(rows, factor, labelled):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (label is not None or not labelled):
            out.append((i, label, [math.floor(factor * x) for x in v]))
    return out


def plain_negatives(rows):
    own = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, q) for i, y, q in kept(rows, 256, True)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    order = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = []
    for anchor in sorted({i for i, _, _ in own if i is not None and i % 100 == 0}):
        _, label, q = min((r for r in own if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scored = [(dot(q, v), i, y) for i, y, v in own if i != anchor]
        for ps, positive, _ in sorted((r for r in scored if r[2] == label), key=order)[:5]:
            fit = sorted((r for r in scored if r[2] != label and 30 * ps <= 100 * r[0] <= 90 * ps), key=order)[:10]
            out += [(anchor, positive, n + 1, i, ps, s) for n, (s, i, _) in enumerate(fit)]
    return out


def test_hard_negatives_of_odd_rows(spark):
    rows = odd_rows(420)
    rows += [(1000 + i, rows[i % 3][1], i % 2) for i in range(60)]  # ties
    got = negatives.hard_negatives(negatives.of_embeddings(table(spark, rows).repartition(5)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_negatives(rows)))


@pytest.mark.parametrize("rows", [[], [(100, None, 1)], [(1, [0.5], 1)], [(100, [0.5], 1), (200, [0.5], 1)]])
def test_hard_negatives_of_few_rows(spark, rows):
    assert negatives.hard_negatives(negatives.of_embeddings(table(spark, rows))).count() == 0


def test_hard_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 2)
    rows = odd_rows(700, 4, 8)
    got = negatives.hard_negatives(negatives.of_embeddings(table(spark, rows)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_negatives(rows)))


def test_planes_drop_most_pairs_early():
    rng = np.random.default_rng(1)
    q = rng.integers(-128, 128, (20_000, 32))
    none = np.full((50, 1), np.inf)
    s = negatives.Searches(np.arange(50), np.zeros(50, np.int64), q[:50], True, -none, none, 5)
    s.add(np.arange(20_000), np.zeros(20_000, np.int64), q, 8)
    a, _, found, score = s.rows()
    product = q[:50] @ q.T
    product[np.arange(50), np.arange(50)] = -(1 << 40)
    assert [sorted(found[a == i].tolist()) for i in range(50)] == [sorted(np.argsort(-product[i], kind="stable")[:5].tolist()) for i in range(50)]
    assert (score == product[a, found]).all() and s.summed < 0.8 * 8 * 50 * 20_000


def test_hard_negatives_too_large(spark):
    with pytest.raises(ValueError, match="beyond"):
        negatives.hard_negatives(negatives.of_embeddings(table(spark, [(100, [1e30], 1), (1, [1.0], 1)])))


def plain_codes(rows):
    own = sorted(kept(rows, 1024, False), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = max(len(q) for _, _, q in own)
    width += -width % 4
    m = width // 4
    vectors = np.array([q + [0] * (width - len(q)) for _, _, q in own])
    books = [vectors[:256, p * m : (p + 1) * m].copy() for p in range(4)]
    for turn in range(5):
        far = [((vectors[:, None, p * m : (p + 1) * m] - books[p]) ** 2).sum(2) for p in range(4)]
        at = [f.argmin(1) for f in far]
        for p in range(4) if turn < 4 else ():
            for e in range(len(books[p])):
                own_rows = vectors[at[p] == e, p * m : (p + 1) * m]
                if len(own_rows):
                    books[p][e] = [int(s) // len(own_rows) for s in own_rows.sum(0)]
    error = sum(f.min(1) for f in far)
    sums = {}
    for (_, label, _), e in zip(own, error.tolist(), strict=True):
        sums[label] = sums.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    return [(i, "".join(f"{at[p][n]:02x}" for p in range(4)), int(error[n]), sums[label], digest) for n, (i, label, _) in enumerate(own)]


@pytest.mark.parametrize(("n", "width"), [(900, 8), (60, 6)])
def test_codes_of_odd_rows(spark, n, width):
    rows = odd_rows(n, width)
    rows += [(5000 + i, rows[i % 3][1], 0) for i in range(40)]  # ties
    got = codes.compress(table(spark, rows).repartition(3)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_codes(rows)))


def test_codes_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "MOST_LABELS", 0)
    rows = odd_rows(50)
    got = codes.compress(table(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_codes(rows)))


def test_codes_of_no_rows(spark):
    assert codes.compress(table(spark, [])).count() == 0 and codes.compress(table(spark, [(1, None, 1)])).count() == 0


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(0, 3, (40, 16))
    rows = spark.createDataFrame([(i, 0, [int(x) for x in np.floor(1024 * (center[i % 40] + rng.normal(0, 0.2, 16)))]) for i in range(4000)], "id long, label int, q array<long>")
    _, _, computed = codes.codebooks(rows)
    assert computed[0] == 4000 * 4 * 256 and all(x < 0.35 * computed[0] for x in computed[1:])


def test_packed_bounds_are_never_above():
    lower = np.abs(np.random.default_rng(4).normal(0, 500, (300, 256)))
    lower[0] = 0
    assert (codes.unpacked(*codes.packed(lower)) <= lower).all()
