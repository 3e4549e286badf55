"""Upkeep of a collection: tags, duplicates, reorganisation, moves, undo."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioweave.functions.folders import is_within, normalize_folder, normalize_folder_name
from folioweave.session import checkpointed

MIN_DOCS, DOMINANT = 3, 0.6
#: Near pairs of tags that the driver takes, at most.
DRIVER_PAIRS = 100_000


def tag_counts(docs: DataFrame) -> DataFrame:
    """tag (trimmed, lower case), n occurrences."""
    tag = F.lower(F.trim("tag"))
    return docs.select(F.explode("tags").alias("tag")).select(tag.alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def deletions(tag, most: int):
    """The strings that remain of a tag after up to ``most`` deletions."""
    level = out = F.array(tag)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))
        out = F.concat(out, level)
    return F.array_distinct(out)


def near_tags(counts: DataFrame, distance: int = 2) -> DataFrame:
    """a < b, distance: tags within an edit distance.

    Two strings within distance d, cut into d + 1 pieces, share a piece that has moved by at most d
    places; tags meet by such pieces, not as all pairs.
    """
    pieces = distance + 1
    length = F.length("tag")
    own = counts.select("tag", length.alias("len"))

    def cut(tag, size, shift):
        """(piece number, piece, length of the other tag) at a shifted place."""
        w = F.greatest(F.ceil(size / pieces).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.struct(i.alias("i"), F.substring(tag, (i * w + 1 + shift).cast("int"), F.when(i == pieces - 1, size - i * w).otherwise(w).cast("int")).alias("piece"), size.cast("int").alias("size")))

    left = own.select("tag", F.explode(cut(F.col("tag"), F.col("len"), F.lit(0))).alias("p")).select(F.col("tag").alias("x"), "p.*")
    # the other tag: as if it had each length in reach, at each shift in reach
    probe = own.select("tag", "len", F.explode(F.sequence(F.greatest(F.col("len") - distance, F.lit(1)), F.col("len") + distance)).alias("size")).select("tag", "size", F.explode(F.sequence(F.lit(-distance), F.lit(distance))).alias("shift"))
    right = probe.select(F.col("tag").alias("y"), F.explode(cut(F.col("tag"), F.col("size"), F.col("shift"))).alias("p")).select("y", "p.*").distinct()
    pairs = left.join(right, ["i", "piece", "size"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # a piece of a short tag may be empty: short tags meet by what is left after as many deletions
    short = own.where(F.col("len") <= 2 * pieces).select("tag", F.explode(deletions(F.col("tag"), distance)).alias("rest"))
    close = short.select(F.col("tag").alias("a"), "rest").join(short.select(F.col("tag").alias("b"), "rest"), "rest").where("a < b").select("a", "b")
    return pairs.unionByName(close).distinct().withColumn("distance", F.levenshtein("a", "b", distance)).where("distance >= 0")


def tag_merges(counts: DataFrame) -> DataFrame:
    """winner, loser: tags in alphabetical order, each near pair merges into the more frequent, the
    earlier of equals; a loser merges once.

    Up to ``DRIVER_PAIRS`` pairs are resolved one by one on the driver, more of them in rounds with the
    same result: a pair waits for the earlier pairs of both its tags. In each round those pairs that
    wait for none are settled together, and what they decide leaves: pairs whose second tag is gone,
    and pairs of a first tag that was gone before its turn.
    """
    n = counts.select("tag", "n")
    pairs = near_tags(counts).select("a", "b").join(n.select(F.col("tag").alias("a"), F.col("n").alias("a_n")), "a").join(n.select(F.col("tag").alias("b"), F.col("n").alias("b_n")), "b")
    rest = checkpointed(pairs.select(F.struct("a", "b").alias("at"), "a", "b", (F.col("a_n") >= F.col("b_n")).alias("first_wins"), F.lit(False).alias("a_gone")))
    if rest.count() <= DRIVER_PAIRS:
        return counts.sparkSession.createDataFrame(_resolved([(r["a"], r["b"], r["first_wins"]) for r in rest.collect()]), "winner string, loser string")
    merges = None
    while not rest.isEmpty():
        ends = rest.select(F.explode(F.array("a", "b")).alias("tag"), "at").groupBy("tag").agg(F.min("at").alias("next"))
        ready = rest.join(ends.select(F.col("tag").alias("a"), F.col("next").alias("a_next")), "a").join(ends.select(F.col("tag").alias("b"), F.col("next").alias("b_next")), "b").where("at = a_next and at = b_next")
        # a first tag that has lost within its own turn still takes losers, but can't lose again
        settled = checkpointed(ready.select("at", "a", "b", F.when(F.col("first_wins"), F.col("a")).when(~F.col("a_gone"), F.col("b")).alias("winner"), F.when(F.col("first_wins"), F.col("b")).when(~F.col("a_gone"), F.col("a")).alias("loser")))
        lost = settled.where("loser is not null")
        found = lost.select("winner", "loser")
        merges = found if merges is None else merges.unionByName(found)
        now = rest.join(settled.select("at"), "at", "left_anti")
        by_second = lost.where("loser = b").select(F.col("loser").alias("tag"))
        by_first = lost.where("loser = a").select(F.col("loser").alias("tag"))
        # gone as a second tag: no turn of its own, and no more merges; gone as a first: its turn goes on
        now = now.join(by_second.withColumnRenamed("tag", "a"), "a", "left_anti").join(by_second.unionByName(by_first).withColumnRenamed("tag", "b"), "b", "left_anti")
        now = now.join(by_first.select(F.col("tag").alias("a"), F.lit(True).alias("out")), "a", "left")
        rest = checkpointed(now.select("at", "a", "b", "first_wins", (F.col("a_gone") | F.coalesce("out", F.lit(False))).alias("a_gone")))
    return merges if merges is not None else counts.select(F.col("tag").alias("winner"), F.col("tag").alias("loser")).limit(0)


def _resolved(pairs: list[tuple[str, str, bool]]) -> list[tuple[str, str]]:
    gone_second: set[str] = set()  # lost before its own turn
    gone_first: set[str] = set()
    merges = []
    for a, b, first_wins in sorted(pairs, key=lambda p: (p[0].encode(), p[1].encode())):
        if a in gone_second or b in gone_second or not first_wins and a in gone_first:
            continue
        merges.append((a, b) if first_wins else (b, a))
        (gone_second if first_wins else gone_first).add(merges[-1][1])
    return merges


def final_winners(merges: DataFrame) -> DataFrame:
    """loser, winner: a loser that wins elsewhere is followed to the end; a ring of losers stays as it is."""
    now = checkpointed(merges.select("loser", "winner"))
    while True:
        on = now.select(F.col("loser").alias("winner"), F.col("winner").alias("next"))
        after = checkpointed(now.join(on, "winner", "left").select("loser", F.when(F.col("next") != F.col("loser"), F.col("next")).otherwise(F.col("winner")).alias("winner")))
        if after.exceptAll(now).isEmpty():
            return after
        now = after


def apply_merges(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """``docs`` (doc_id, tags, ...) with merged tags, each once."""
    final = final_winners(merges)
    each = docs.select("doc_id", F.posexplode("tags").alias("at", "loser")).join(final, "loser", "left").select("doc_id", "at", F.coalesce("winner", "loser").alias("tag"))
    new = each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "tag"))), lambda t: t["tag"]).alias("new_tags"))
    return docs.join(new, "doc_id", "left").withColumn("tags", F.array_distinct(F.coalesce("new_tags", "tags"))).select(*docs.columns)


def merge_journal(docs: DataFrame, merges: DataFrame, now, days: int = 30) -> DataFrame:
    """An entry for each merge with what undoes it."""
    hit = docs.select("doc_id", F.explode("tags").alias("loser")).join(merges.select("winner", "loser"), "loser").groupBy("winner", "loser").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    return hit.select(F.lit("tag_merge").alias("action_type"), F.concat(F.lit("Tag '"), "loser", F.lit("' → '"), "winner", F.lit("' ("), F.size("doc_ids").cast("string"), F.lit(" Dok.)")).alias("summary"), F.to_json(F.struct("winner", "loser", "doc_ids")).alias("undo_payload"), (now + F.make_interval(days=F.lit(days))).alias("expires_at"), F.lit(False).alias("undo_applied"))


def undo_merge(docs: DataFrame, winner: str, loser: str, doc_ids: list[int]) -> DataFrame:
    back = F.array_distinct(F.transform("tags", lambda t: F.when(t == winner, F.lit(loser)).otherwise(t)))
    return docs.withColumn("tags", F.when(F.col("doc_id").isin(doc_ids), back).otherwise(F.col("tags")))


def reorganisation(members: DataFrame, docs: DataFrame, rejected: DataFrame, labels: DataFrame) -> DataFrame:
    """Suggested folders of documents in communities that are spread over folders.

    ``members``: doc_id, community_id; ``rejected``: doc_id, suggested_folder; ``labels``:
    community_id, label. A community goes to the folder of at least 0.6 of its documents, else to
    one named by its most frequent tag, its first norm's prefix or its label.
    """
    rows = members.join(docs.where("status = 'indexed'"), "doc_id").select("doc_id", "community_id", normalize_folder("folder").alias("folder"), "tags", "norm_id")
    size = rows.groupBy("community_id", "folder").agg(F.count("*").alias("k")).groupBy("community_id").agg(F.sum("k").alias("n"), F.count("*").alias("folders"), F.max(F.struct("k", "folder")).alias("top"))
    tags = rows.select("community_id", F.explode("tags").alias("tag")).select("community_id", F.trim("tag").alias("tag")).where("tag <> ''").groupBy("community_id", "tag").agg(F.count("*").alias("k")).groupBy("community_id").agg(F.max(F.struct("k", "tag"))["tag"].alias("tag"))
    norms = rows.where("norm_id is not null").groupBy("community_id").agg(F.min_by(F.substring_index("norm_id", " ", 1), "doc_id").alias("norm"))
    named = size.where(f"n >= {MIN_DOCS} and folders >= 2").join(tags, "community_id", "left").join(norms, "community_id", "left").join(labels, "community_id", "left")
    target = F.when(F.col("top.k") / F.col("n") >= DOMINANT, F.col("top.folder")).otherwise(normalize_folder(F.coalesce("tag", "norm", "label", F.lit("Sammlung"))))
    goal = named.select("community_id", target.alias("suggested_folder"))
    found = rows.join(goal, "community_id").where("folder <> suggested_folder").select("doc_id", F.col("folder").alias("current_folder"), "suggested_folder", "community_id", F.lit("pending").alias("status"))
    return found.join(rejected.select("doc_id", "suggested_folder"), ["doc_id", "suggested_folder"], "left_anti").select("doc_id", "current_folder", "suggested_folder", "community_id", "status")


def replace_pending(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.where("status <> 'pending'").unionByName(new, allowMissingColumns=True)


#: From a state by an action to a state.
DECISIONS = {("pending", "accept"): "accepted", ("pending", "reject"): "rejected", ("accepted", "undo"): "pending"}


def decide(suggestions: DataFrame, decisions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Suggestions after decisions (key, action); what the state machine doesn't allow changes nothing."""
    new = F.col("status")
    for (state, action), to in DECISIONS.items():
        new = F.when((F.col("status") == state) & (F.col("action") == action), F.lit(to)).otherwise(new)
    return suggestions.join(decisions.select(key, "action"), key, "left").withColumn("status", new).drop("action")


def move_documents(docs: DataFrame, moves: DataFrame) -> DataFrame:
    """``docs`` with the folders of ``moves`` (doc_id, target)."""
    return docs.join(moves.select("doc_id", "target"), "doc_id", "left").withColumn("folder", F.coalesce(normalize_folder_or_null("target"), "folder")).drop("target")


def normalize_folder_or_null(name: str):
    return F.when(F.col(name).isNotNull(), normalize_folder(name))


def without_subtree(docs: DataFrame, folder: str) -> DataFrame:
    """The documents outside a folder and what lies under it."""
    return docs.where(~is_within(F.col("folder"), F.lit(normalize_folder_name(folder))))


def cascade(children: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of a child table whose document is still there."""
    return children.join(docs.select("doc_id"), "doc_id", "left_semi")


def keep_first(rows: DataFrame, *key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")


def decide_duplicates(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``pairs`` (keep, remove, status) after decisions (keep, remove, action); only pending ones change."""
    new = F.when((F.col("status") == "pending") & (F.col("action") == "accept"), "accepted").when((F.col("status") == "pending") & (F.col("action") == "reject"), "rejected").otherwise(F.col("status"))
    return pairs.join(decisions.select("keep", "remove", "action"), ["keep", "remove"], "left").withColumn("status", new).drop("action")


def without_duplicates(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents but for those that accepted pairs remove. A document that one pair keeps and another
    removes goes; the keeper of a hash is the same in all its pairs."""
    gone = pairs.where("status = 'accepted'").select(F.col("remove").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti")


def move_journal(suggestions: DataFrame, now, days: int = 30) -> DataFrame:
    """An entry for each accepted suggestion with what undoes the move."""
    moved = suggestions.where("status = 'accepted'")
    return moved.select("doc_id", F.lit("folder_move").alias("action_type"), F.concat(F.col("current_folder"), F.lit(" → "), F.col("suggested_folder")).alias("summary"), F.to_json(F.struct("doc_id", F.col("current_folder").alias("folder"))).alias("undo_payload"), (now + F.make_interval(days=F.lit(days))).alias("expires_at"), F.lit(False).alias("undo_applied"))


def undo_moves(docs: DataFrame, journal: DataFrame) -> DataFrame:
    """``docs`` with the folders they had before the journal's moves, but for those undone already."""
    back = journal.where("not undo_applied").select(F.from_json("undo_payload", "doc_id long, folder string").alias("u")).select("u.doc_id", F.col("u.folder").alias("target"))
    return move_documents(docs, back)
