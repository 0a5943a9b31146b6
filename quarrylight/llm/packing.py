"""Texts put together into sequences of fixed capacity, shortest pack first over the histogram of lengths.

Only the histogram (at most one entry a length up to the capacity) comes to the driver. Lengths are placed longest
first, each into the pack with the most room, counting how often every packing pattern occurs. Patterns are then joined
back to the documents by the rank of a document within its length. Ranks are worked out in parts whose number grows with
the pieces of a length; pieces that fill a sequence take no part.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut
from quarrylight.llm.tokens import TOKENIZER, token_sizes

CAPACITY = 2048
SLOTS = "length long, from_rank long, to_rank long, first_sequence long, per_sequence long, place long"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one pack, how many such packs): all items of ``histogram`` (length to count) packed.

    Longest lengths first; each goes to the packs with the least in them that still have room. Where a pack of just the
    room that is needed exists, it is filled up first, which leaves no gap.
    """
    packs: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, count]
    rooms: list[int] = []  # a heap of rooms, the largest first

    def put(room: int, lengths: tuple[int, ...], count: int) -> None:
        if not packs[room]:
            heapq.heappush(rooms, -room)
        packs[room].append([lengths, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fresh: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            exact = length if packs.get(length) else None
            room = exact if exact is not None else (-rooms[0] if rooms and -rooms[0] >= length else None)
            if room is None:
                fit = min(capacity // length, left)
                whole = left // fit
                fresh.append((capacity - fit * length, (length,) * fit, whole))
                left -= whole * fit
                continue
            lengths, count = packs[room].pop()
            fit = min(room // length, left) if room != length else 1
            # Small lengths go in several at a time, as long as no other pack has more room.
            others = -rooms[1] if len(rooms) > 1 else 0
            fit = max(1, min(fit, (room - others) // length + 1))
            used = min(count, left // fit)
            if not used:
                fit, used = left, 1
            if count > used:
                packs[room].append([lengths, count - used])
            put(room - fit * length, lengths + (length,) * fit, used)
            left -= used * fit
        for room, lengths, count in fresh:
            put(room, lengths, count)
    return [(tuple(lengths), count) for entries in packs.values() for lengths, count in entries]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of a length go to which sequences: (length, from, to, first sequence, items of it a sequence, first place there)."""
    out, taken, sequence = [], defaultdict(int), 0
    for lengths, count in patterns:
        place = 0
        while place < len(lengths):
            length = lengths[place]
            same = 1
            while place + same < len(lengths) and lengths[place + same] == length:
                same += 1
            out.append((length, taken[length], taken[length] + same * count - 1, sequence, same, place))
            taken[length] += same * count
            place += same
        sequence += count
    return out


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, rows_per_part: int = 50_000) -> DataFrame:
    """``sequence_id, place, doc_id, piece, from_token, to_token, tokens``: every document in a sequence of at most ``capacity`` tokens.

    A document longer than the capacity is split into pieces of full capacity and a rest; no other is. Tokens are those
    from ``from_token`` (from 0) up to, not including, ``to_token``. Documents without tokens (null or empty texts)
    come out in sequence 0 with place -1; sequences of one whole piece have negative numbers, all others count from 0.
    Null ids give no row; an id given twice comes out once (with its longest text); an empty table gives none.
    """
    spark = documents.sparkSession
    sizes = cut(token_sizes(documents, tokenizer=tokenizer).groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    pieces = sizes.where("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast(ceil(tokens / {capacity}.0) as bigint) - 1")))).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("from_token"), F.least("tokens", (F.col("piece") + 1) * capacity).alias("to_token")
    )
    pieces = pieces.withColumn("length", F.col("to_token") - F.col("from_token"))
    # A full piece is a sequence of its own and needs no rank: the number of full pieces before its document, and its place there.
    full, partial = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in partial.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a length below the capacity
    # A length that many pieces have is ranked in parts, so no task gets a whole one.
    parts = spark.createDataFrame([(k, -(-n // rows_per_part)) for k, n in histogram.items()], "length long, parts long")
    salted = partial.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id")) - 1)
    ranked = local.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    # Ranks and slots meet by length and block of ranks, so a length with many pieces or slots is spread as well.
    block = lambda c: F.expr(f"{c} div {rows_per_part}")
    slots = spark.createDataFrame(_slots(pack_histogram(histogram, capacity)), SLOTS).withColumn("block", F.explode(F.sequence(block("from_rank"), block("to_rank"))))
    placed = ranked.withColumn("block", block("rank")).join(slots, ["length", "block"]).where("rank between from_rank and to_rank")
    within = F.col("rank") - F.col("from_rank")
    packed = placed.select(
        (F.col("first_sequence") + F.expr("(rank - from_rank) div per_sequence")).alias("sequence_id"),
        (F.col("place") + within % F.col("per_sequence")).alias("place"),
        "doc_id", "piece", "from_token", "to_token", F.col("length").alias("tokens"),
    )
    zero = F.lit(0).cast("long")
    counts = sizes.where(F.col("tokens") >= capacity).select("doc_id", F.expr(f"tokens div {capacity}").alias("n")).withColumn("row", F.xxhash64("doc_id"))
    starts = _before(counts, rows_per_part)
    alone = full.join(starts, "doc_id").select((-1 - F.col("start") - F.col("piece")).alias("sequence_id"), zero.alias("place"), "doc_id", "piece", "from_token", "to_token", F.col("length").alias("tokens"))
    empty = sizes.where("tokens = 0").select(zero.alias("sequence_id"), F.lit(-1).cast("long").alias("place"), "doc_id", zero.alias("piece"), zero.alias("from_token"), zero.alias("to_token"), zero.alias("tokens"))
    return packed.unionByName(alone).unionByName(empty)


def _before(counts: DataFrame, rows_per_part: int) -> DataFrame:
    """``doc_id, start``: the sum of ``n`` over all documents before this one, in some fixed order, worked out in parts."""
    parts = max(1, -(-counts.count() // rows_per_part))
    marked = counts.withColumn("part", F.pmod("row", F.lit(parts)))
    # One row a part; the documents of one part meet in a task.
    totals = marked.groupBy("part").agg(F.sum("n").alias("total")).withColumn("first", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("inside", inside).join(totals, "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"))
