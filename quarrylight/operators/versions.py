"""Incremental ingest, snapshots as intervals of membership, content identity, comparison of two readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.parts import running_before

# Which state of a snapshot may follow which.
TRANSITIONS = {
    "building": {"sealed"}, "sealed": {"verified", "building"}, "verified": {"release_candidate", "sealed"}, "release_candidate": {"active", "verified"},
    "active": {"superseded"}, "superseded": {"release_candidate"},
}


class VersionError(ValueError):
    """A change that would break the history."""


def unchanged(new: DataFrame, old: DataFrame) -> DataFrame:
    """``source_id, path, skip``: whether a found file is stored already with the same hash."""
    stored = old.select("source_id", "path", F.col("hash").alias("old_hash")).distinct()
    j = new.select("source_id", "path", "hash").distinct().join(stored, ["source_id", "path"], "left")
    return j.groupBy("source_id", "path").agg(F.coalesce(F.bool_or(F.col("hash") == F.col("old_hash")), F.lit(False)).alias("skip"))


def appended(old: Column, new: Column) -> Column:
    """True if ``new`` is ``old`` with something added."""
    return (F.length(new) > F.length(old)) & new.startswith(old)


def deleted(existing: DataFrame, discovered: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(discovered.select(*keys).distinct(), keys, "left_anti")


def delta_plan(previous: DataFrame, desired: DataFrame) -> DataFrame:
    """``item_key, action``: open, unchanged, replace or close; both sides have ``item_key, identity``. Repeated keys are an error."""
    for side, name in ((previous, "previous"), (desired, "desired")):
        if side.groupBy("item_key").count().where("count > 1").limit(1).count():
            raise VersionError(f"an item key stands twice in the {name} membership")
    j = previous.select("item_key", F.col("identity").alias("old")).join(desired.select("item_key", F.col("identity").alias("new")), "item_key", "full")
    action = F.when(F.col("old").isNull(), "open").when(F.col("new").isNull(), "close").when(F.col("old") == F.col("new"), "unchanged").otherwise("replace")
    return j.select("item_key", action.alias("action"))


def commit(membership: DataFrame, desired: DataFrame, seq: int) -> DataFrame:
    """Intervals (item_key, identity, valid_from, valid_to) after snapshot ``seq``: gone ones closed, new ones opened, others as they are.

    Unchanged items cost no new row; an item that comes back opens a new interval.
    """
    open_now = membership.where("valid_to is null")
    closed = membership.where("valid_to is not null")
    kept = open_now.join(desired.select("item_key", "identity"), ["item_key", "identity"], "left_semi")
    ended = open_now.join(desired.select("item_key", "identity"), ["item_key", "identity"], "left_anti").withColumn("valid_to", F.lit(seq).cast("long"))
    opened = desired.select("item_key", "identity").join(open_now, ["item_key", "identity"], "left_anti").select("item_key", "identity", F.lit(seq).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return closed.unionByName(kept).unionByName(ended).unionByName(opened)


def visible(membership: DataFrame, seq: int) -> DataFrame:
    return membership.where((F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq)))


def overlaps(membership: DataFrame) -> DataFrame:
    """Items of which two intervals overlap; there must be none."""
    later = F.lead("valid_from").over(Window.partitionBy("item_key").orderBy("valid_from", F.col("valid_to").asc_nulls_last()))
    return membership.withColumn("_next", later).where(F.col("_next").isNotNull() & (F.col("valid_to").isNull() | (F.col("_next") < F.col("valid_to")))).select("item_key").distinct()


def advance(state: str, to: str) -> str:
    """The new state of a snapshot; raises where the step isn't allowed."""
    if to not in TRANSITIONS.get(state, set()):
        raise VersionError(f"a snapshot can't go from {state} to {to}")
    return to


def activate(pointers: DataFrame, chosen: DataFrame) -> DataFrame:
    """``source_id, seq, receipt``: active snapshots after all of ``chosen`` (source_id, seq) are switched at once."""
    rows = pointers.select("source_id", "seq").join(chosen.select("source_id"), "source_id", "left_anti").unionByName(chosen.select("source_id", "seq"))
    return rows.withColumn("receipt", F.sha2(F.concat_ws(":", "source_id", "seq"), 256))


def verify_append(rows: DataFrame) -> DataFrame:
    """``item_key, verdict`` of files that should only grow (old_size, old_prefix_hash, new_size, new_prefix_hash)."""
    verdict = F.when(F.col("new_size") < F.col("old_size"), "shrunken").when(F.col("new_prefix_hash") != F.col("old_prefix_hash"), "drifted").when(F.col("new_size") == F.col("old_size"), "same").otherwise("grown")
    return rows.select("item_key", verdict.alias("verdict"))


def bodies(texts: DataFrame) -> DataFrame:
    """``digest, size, uses, first_id``: distinct contents of ``id, text``. Equal identity with unequal bytes is an error, told by ``clash``."""
    return texts.groupBy(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size")).agg(F.count("*").alias("uses"), F.min("id").alias("first_id"), (F.min("text") != F.max("text")).alias("clash"))


def pack_offsets(items: DataFrame, pack: str) -> DataFrame:
    """``id, at``: where an item starts in its pack: the sizes of those before it."""
    placed = running_before(items.select(pack, "id", "size"), [pack], "id", F.coalesce(F.col("size").cast("long"), F.lit(0)))
    return placed.select(pack, "id", F.col("before").cast("long").alias("at"))


def repack(packs: DataFrame, dead_share: float = 0.5, free_bytes: int | None = None) -> DataFrame:
    """Packs worth rewriting: much of them dead, and their live part fits the free space."""
    worth = packs.where(F.col("dead") >= dead_share * F.col("stored"))
    return worth if free_bytes is None else worth.where(F.col("live") <= free_bytes)


def align(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """``piece_id, at, state``: the one place of a piece in its file (characters from 1); none or several is ambiguous."""
    j = pieces.join(files, "file_id")
    first = F.expr("locate(piece, whole)")
    again = F.expr("locate(piece, whole, cast(locate(piece, whole) + 1 as int))")
    state = F.when(first == 0, "absent").when(again > 0, "ambiguous").otherwise("unique")
    return j.select("piece_id", F.when((first > 0) & (again == 0), first).cast("long").alias("at"), state.alias("state"))


def dual_read(old: DataFrame, new: DataFrame) -> DataFrame:
    """``query_id, id, verdict``: how two readers' ranked hits (query_id, id, rank, score) differ."""
    a = old.select("query_id", "id", F.col("rank").alias("old_rank"), F.col("score").alias("old_score"))
    b = new.select("query_id", "id", F.col("rank").alias("new_rank"), F.col("score").alias("new_score"))
    verdict = F.when(F.col("old_rank").isNull(), "missing_old").when(F.col("new_rank").isNull(), "missing_new").when(F.col("old_rank") != F.col("new_rank"), "score_order").otherwise("same")
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", verdict.alias("verdict"))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` put in by key."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, left_count, right_count, drift, status`` of two tables that should agree."""
    a = left.groupBy(key).agg(F.count("*").alias("left_count"))
    b = right.groupBy(key).agg(F.count("*").alias("right_count"))
    zero = F.lit(0).cast("long")
    j = a.join(b, key, "full").select(key, F.coalesce("left_count", zero).alias("left_count"), F.coalesce("right_count", zero).alias("right_count"))
    gap = F.abs(F.col("left_count") - F.col("right_count"))
    return j.select(key, "left_count", "right_count", gap.alias("drift"), F.when(gap == 0, "in_sync").otherwise("drifted").alias("status"))
