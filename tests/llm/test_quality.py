"""Quality scores: the risk's slope by differences, held-out rows, odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioweave.llm import quality


def test_measures_of_plain_and_odd_texts():
    got = quality.measures(pa.array(["", None, " \n\t ", "Aa bb! bb! 12\nx x", "ä", "w " * 600_000]))
    assert np.isnan(got[:3]).all() and not np.isnan(got[3:]).any()
    size, words, mean, longest, upper, digits, symbols, wide, twice, again, most, looped, copied, per_line, bare, ends = got[3].tolist()
    assert (round(2**size), round(2**words), round(2**longest), round(2**per_line, 3)) == (18, 7, 4, 4.0)
    np.testing.assert_allclose([mean, upper, digits, symbols, wide, twice, again, most, looped, copied, bare, ends], [(2 + 3 + 3 + 2 + 1 + 1) / 6, 1 / 8, 2 / 17, 2 / 17, 0, 2 / 17, 2 / 6, 2 / 6, 0, 0, 0, 0], rtol=1e-6)
    assert got[5][9] > 0.999 and got[5][10] == 1 and got[5][11] > 0.999 and got[4][7] == 1


def test_slope_of_the_risk_by_differences(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, quality.MEASURES)], bool(i % 3 == 0)) for i in range(300)], "doc_id long, measures array<float>, trusted boolean")
    bounds, weights = quality.cuts(rows), rng.normal(0, 0.3, quality.SLOTS)
    held = rows.toPandas()
    at = quality.slots(pa.array(held["measures"].tolist(), pa.list_(pa.float32())), bounds)

    def risk(w):
        p = 1 / (1 + np.exp(-(w[at].sum(1) + w[-1])))
        good = p[held["trusted"]]
        return prior * (1 - good).mean() + p.mean() - prior * good.mean(), p.mean() - prior * good.mean()

    slope, _, loss, count = quality._sums(rows, bounds, weights, True)
    for prior in (0.5, 1.9):  # the second makes the part of the negatives negative
        got = quality.risk_slope(slope, loss, count, prior)
        value, negative = risk(weights)
        for i in (*rng.choice(quality.SLOTS - 1, 12).tolist(), quality.SLOTS - 1):
            step = np.zeros(quality.SLOTS)
            step[i] = 1e-5
            plain = risk(weights + step)
            expected = (plain[0] - value) / 1e-5 if negative >= 0 else -(plain[1] - negative) / 1e-5
            assert abs(got[i] - expected) < 1e-4


def test_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{name}.parquet") for name in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (got[got["quality"] == x] for x in (1, 0))
    assert (good["predicted"] == 1).mean() >= 0.95 and (bad["predicted"] == 0).mean() >= 0.95
    assert (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()).mean() >= 0.98


def test_odd_rows(spark):
    text = "The quiet river ran past the old mill and the people of the village walked home. "
    docs = spark.createDataFrame([(i, text * (1 + i % 5) + str(i), 0.0, True) for i in range(60)] + [(i, "BUY!!! NOW!!! $$$ " * 9, 1.0, False) for i in range(60, 80)] + [(90, None, 0.0, None), (91, "", None, None), (None, text, None, None), (3, text, None, None)], "doc_id long, text string, score double, trusted boolean")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(70, 0, 0), (None, 1, 0), (5, None, 0), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert got.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0
    means = [r[0] for r in got.groupBy(F.col("doc_id").between(60, 79)).agg(F.avg("score").alias("m")).orderBy("m").select("m").collect()]
    assert got.where("doc_id between 60 and 79 and predicted = 1").count() == 0 and means[-1] > 0.5
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id between 60 and 79").count() == 0 and kept.where("doc_id is null").count() == 1
    none = quality.quality(docs, labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5} and quality.quality(docs.where("false"), labels).count() == 0
