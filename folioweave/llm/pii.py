"""Personal data: fixed patterns, and bootstrapped contextual extraction for what they miss.

Fixed patterns give the seeds. Every word with a digit or an at sign is an instance; the words
before and after it, each with the instance's shape (digits 0, letters a), are its lexical
patterns. Instances and patterns form a graph that is scored in turns: a pattern's confidence is the
mean score of its instances, counted from ``SUPPORT`` positive ones on; an instance that is no seed
is as likely as that not all of its confident patterns are wrong. Instances that reach ``ACCEPT``
are added as spans of the kind ``context`` where no fixed pattern has matched.

DataFrame and SQL operations only. Text is read where it lies; only mentions move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm import spans
from folioweave.llm.common import cut, text_key
from folioweave.llm.spans import Kind

SUPPORT = 3
CONFIDENT = 0.6
ACCEPT = 0.75

_LUHN = "aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, cast(substr(reverse({d}), i, 1) as int), cast(substr('0246813579', cast(substr(reverse({d}), i, 1) as int) + 1, 1) as int))) % 10 = 0"
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"

#: The kinds in their order.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", "contains({text}, '@')"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "forall(split({m}, '[.]'), o -> length(ltrim('0', o)) <= 3 and coalesce(cast(nullif(ltrim('0', o), '') as int), 0) <= 255)", "{text} rlike '[0-9][.][0-9]'"),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", f"length({_DIGITS}) between 14 and 19 and {_LUHN.replace('{d}', _DIGITS)}", "{text} rlike '[0-9]'"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15", "contains({text}, '+')"),
]
#: Runs of white space between words.
SEPARATOR = r"[\x20\x09-\x0D]+"
_MENTION = Kind("context", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+", "true", "{text} rlike '[0-9@]'")


def base_spans(text: str = "text"):
    return F.concat(*[spans.find(kind, i, text) for i, kind in enumerate(KINDS)])


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, key, start, end, instance, left, right, seed of every word that may be an identifier.

    ``docs`` has doc_id, key, text and base.
    """
    # the words of a text and its mentions come in the same order: a mention is a word with a digit or an at sign
    words = f"split(text, r'{SEPARATOR}', -1)"
    beside = f"element_at(transform(array({words}), w -> transform(filter(sequence(1, size(w)), i -> element_at(w, i) rlike '[0-9@]'), i -> named_struct('left', if(i > 1, element_at(w, i - 1), ''), 'right', if(i < size(w), element_at(w, i + 1), '')))), 1)"
    both = F.arrays_zip(spans.find(_MENTION, len(KINDS)).alias("m"), F.expr(beside).alias("w"))
    found = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "key", "base", F.explode(both).alias("x"))
    found = found.select("doc_id", "key", "base", "x.m", "x.w")
    return found.select(
        "doc_id", "key", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
        F.regexp_replace(F.lower("m.value"), r"^[^a-z0-9+(]+|[^a-z0-9)]+$", "").alias("instance"),
        F.lower("w.left").alias("left"), F.lower("w.right").alias("right"),
        F.exists("base", lambda b: (b["start"] < F.col("m.end")) & (b["end"] > F.col("m.start"))).alias("seed"),
    )


def scored_instances(found: DataFrame) -> DataFrame:
    """instance, score of every instance of ``found`` (instance, left, right, seed).

    Scores only rise; the turns end when no more instances reach ``ACCEPT``.
    """
    shape = F.regexp_replace(F.regexp_replace("instance", "[0-9]", "0"), r"\p{L}", "a")
    patterns = F.array(F.concat_ws("\x1f", F.lit("l"), F.nullif("left", F.lit("")), shape), F.concat_ws("\x1f", F.lit("r"), F.nullif("right", F.lit("")), shape))
    edges = found.where("instance <> ''").select(F.explode(patterns).alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = cut(edges)
    rows = edges.count()
    scores = cut(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score")), rows)
    accepted = None
    while (now := scores.where(F.col("score") >= ACCEPT).count()) != accepted:
        accepted = now
        rated = edges.join(scores, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count_if(F.col("score") >= ACCEPT).alias("positive"))
        confident = rated.where((F.col("confidence") >= CONFIDENT) & (F.col("positive") >= SUPPORT))
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
        likely = edges.where("not seed").join(confident, "pattern").groupBy("instance").agg((1 - doubt).alias("likely"))
        scores = cut(scores.join(likely, "instance", "left").select("instance", F.greatest("score", F.coalesce("likely", F.lit(0.0))).alias("score")), rows)
    return scores


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind, value) of every row of ``docs``.

    Null texts count as empty and have none; repeated rows each get all of their spans. An empty
    table gives no rows. The words beside a mention count whole, however long or far off.
    """
    own = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans())
    found = cut(mentions(own))
    scores = scored_instances(found).where(F.col("score") >= ACCEPT)
    added = found.where("not seed").join(scores, "instance").select("doc_id", "key", F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(_MENTION.name).alias("kind"), F.col("instance").alias("value")).alias("span"))
    added = added.groupBy(F.col("doc_id").alias("added_id"), F.col("key").alias("added_key")).agg(F.collect_set("span").alias("added"))
    joined = own.select("doc_id", "key", "base").join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("key") == F.col("added_key")), "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {spans.SPANS})"))).alias("spans"))
