"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is ``-ln(u) / weight``: u in (0, 1) comes from a hash of doc_id and text, the
weight from the text's quality, and the documents of a source with the least keys are a weighted
sample without replacement. A source whose target is k times its size and a rest gives k complete
epochs; the rest is filled in key order up to the document that meets it, which is taken if that
brings the source nearer to its target.

The order is never built as a whole. ``1 - exp(-key)`` rises with the key and lies in (0, 1); its
``BUCKETS`` equal ranges are summed for each source, the sums say in which range the budget ends,
and only that range's documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.llm.common import WORD, cut, free_name

WEIGHTS = (5, 2, 1)
#: Sources whose targets are broadcast, at most; beyond that they are joined by source.
BROADCAST_SOURCES = 20_000
SHARE = 1.5
MOST = 2.0
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """0.1 to 1: the share of letters, digits, spaces and plain punctuation among the characters."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\x20\n.,;:!?'()-]+", ""))
    return F.coalesce(1 - 0.9 * odd / F.nullif(F.length(text), F.lit(0)), F.lit(1.0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts, the same in every run."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. Sharing out what exceeds
    ``most`` times a source's size until nothing does is the same as giving every source
    ``least(most * size, level * weight)`` for the one level that spends the total: with sources in
    order of cap to weight, it is the first at which the next cap isn't met.
    """
    every = W.partitionBy()
    ranked = sizes.withColumn("nth", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = every.orderBy("ratio", "nth")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every))
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(every)["level"]
    return ranked.withColumn("level", level).select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, key, size, source_size, target, epochs (long: times the document is taken), taken.

    ``docs`` has doc_id, text, source. Null and empty texts have size 0: they are part of complete
    epochs and take no budget. Repeated rows have equal keys and are taken one by one. An empty table
    gives no rows.
    """
    text = F.col("text")
    u = uniform(F.col("doc_id"), F.md5(F.coalesce(text, F.lit(""))))
    key = -F.log(u) / (quality(text) if weight is None else weight)
    base = cut(docs.select("doc_id", "source", word_count(text).alias("size"), key.alias("key"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key")))
    base = base.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int"))
    ranges = cut(base.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("complete", F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(1.0)) + 1e-12).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.col("target") - F.col("complete") * F.col("source_size"), F.lit(0.0)))
    goal = cut(goal.withColumnRenamed("source", "goal_source"))
    run = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(run), F.lit(0)))
    # one row for each source: the range in which its budget ends
    ends = before.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).where("before < rest and rest <= before + range_size")
    last = ends.groupBy("goal_source").agg(F.max(F.struct("range", "before")).alias("last")).withColumnRenamed("goal_source", "last_source")
    goal = goal.join(last, F.col("goal_source").eqNullSafe(F.col("last_source")), "left").select("goal_source", "source_size", "target", "complete", "rest", F.coalesce("last.range", F.lit(-1)).alias("last_range"), F.coalesce("last.before", F.lit(0)).alias("last_before"))
    goal = cut(goal)
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    rows = base.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    order = W.partitionBy("source", "range").orderBy("key", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = rows.where("range = last_range").withColumn("reach", F.col("last_before") + F.sum("size").over(order))
    inside = inside.withColumn("more", (F.col("reach") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("reach")
    rest = rows.where("range <> last_range").withColumn("more", (F.col("range") < F.col("last_range")).cast("long"))
    taken = rest.unionByName(inside).withColumn("epochs", F.col("complete") + F.col("more"))
    return taken.select("doc_id", "source", "text_key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def draw(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns as they are."""
    name = {x: free_name(docs.columns, f"mix_{x}") for x in ("id", "source", "key", "epochs", "copies", "nth", "takes")}
    times = mix(docs, **settings).groupBy("doc_id", "source", "text_key").agg(F.sum("epochs").cast("int").alias("epochs"), F.count("*").alias("copies"))
    times = times.select(*[F.col(c).alias(name[x]) for x, c in (("id", "doc_id"), ("source", "source"), ("key", "text_key"), ("epochs", "epochs"), ("copies", "copies"))])
    key = F.md5(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times[name["id"]]) & docs["source"].eqNullSafe(times[name["source"]]) & (key == times[name["key"]]))
    epochs, copies = F.col(name["epochs"]), F.col(name["copies"])
    # rows with equal id, source and text share their takes: the first of them, in order of their JSON, get one more
    nth = F.row_number().over(W.partitionBy(name["id"], name["source"], name["key"]).orderBy(F.to_json(F.struct(*[docs[c] for c in docs.columns]))))
    single = joined.where(copies == 1).withColumn(name["takes"], epochs)
    many = joined.where(copies > 1).withColumn(name["nth"], nth)
    many = many.withColumn(name["takes"], (F.floor(epochs / copies) + (F.col(name["nth"]) <= epochs % copies).cast("int")).cast("int")).drop(name["nth"])
    taken = single.unionByName(many).where(F.col(name["takes"]) > 0)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(name["takes"]))).alias(name["nth"])).select(*docs.columns)
