"""Records of several sources mixed so that each source has its target share of all tokens.

Every record has an expected number of copies that grows with a power of its size, capped at the source's repeat limit
and scaled so that the source's expected tokens are its goal. The whole part of that number are certain copies. The
rest, a number below one that differs by record, is its odds of one copy more, drawn by Pareto order sampling: records
are ranked by random odds over inclusion odds, and those below a threshold are taken, which is where their tokens reach
what the certain copies left open. The random numbers are hashes of the record's id, so a draw can be repeated and a
lost task gives the same again.

Only sums by source and bucket come to the driver: their number is bounded by the targets and the buckets, whatever the
records.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut
from quarrylight.llm.tokens import TOKENIZER, token_sizes

#: Buckets a source: of sizes (a power of two has 16), and of the ranking variable.
SIZE_STEPS = 16
RANK_BUCKETS = 4096
#: Records on either side of a threshold among which it is corrected.
FIXED = 64


def _scale(goal: float, most: int, sums: list[tuple[float, float]]) -> float:
    """``c`` with which records whose weight is w get ``min(most, c * w)`` copies and give ``goal`` tokens together.

    ``sums``: (weight, tokens) of the buckets of one source.
    """
    held = sorted(sums, reverse=True)
    open_ = sum(w * t for w, t in held)
    capped = 0.0
    for w, t in held:
        c = (goal - most * capped) / open_ if open_ > 0 else 0.0
        if c * w <= most * (1 + 1e-12):
            return max(c, 0.0)
        capped, open_ = capped + t, open_ - w * t
    return most / min(w for w, _ in held) if held else 0.0


def _by_source(values: dict[str, list], columns: str, spark) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in sorted(values.items())], "source string, " + columns)


def mix_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, size_power: float = 0.25, whole: bool = False) -> DataFrame:
    """``doc_id, source, tokens, expected, copies``: how often each drawn record is used (at least once, at most ``max_repeats`` times).

    ``expected`` is the number of copies the record has on average over all draws; it grows with its tokens to the power
    of ``size_power`` (0: the same for all records of a source). Without ``total_tokens`` the mixture is as large as it
    can be with all shares met by the sources that have tokens at all, or with ``whole`` as large as all that the sources
    have. With a total (or ``whole``), a source too small for its share gives
    all it has, ``max_repeats`` times. A source's tokens miss its goal by less than one record, mostly by a token or none. Sources that aren't in ``targets``, null sources and ids, and records without tokens
    aren't drawn; an id given twice counts once (by its smallest source and text); of a source named twice in
    ``targets`` the shares are added and the smaller repeat limit holds; a null share is 0, a null limit 1.
    """
    spark = documents.sparkSession
    wanted = _wanted(targets)
    sizes = cut(token_sizes(documents.where(F.col("source").isin(sorted(wanted))), "source", tokenizer=tokenizer).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.*").where("tokens > 0"))
    step = F.floor(F.log2("tokens") * SIZE_STEPS).cast("int")
    held: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in sizes.groupBy("source", step.alias("step")).agg(F.sum("tokens").alias("tokens")).collect():  # at most targets x SIZE_STEPS x 63 rows
        held[r["source"]].append((r["step"], r["tokens"]))
    able = {s: (share, most, sum(t for _, t in held[s])) for s, (share, most) in wanted.items() if s in held and share > 0 and most > 0}
    if total_tokens is None:
        total_tokens = sum(t for _, _, t in able.values()) if whole else min((most * tokens / share for share, most, tokens in able.values()), default=0)
    weight = lambda k: 2.0 ** ((k + 0.5) / SIZE_STEPS * size_power)
    goals = {s: min(float(most * tokens), share * total_tokens) for s, (share, most, tokens) in able.items()}
    # A source that must give all has no odds; else its records' expected copies follow their size.
    rates = {s: [float(most), 0.0 if goals[s] >= most * tokens else _scale(goals[s], most, [(weight(k), float(t)) for k, t in held[s]])] for s, (_, most, tokens) in able.items()}
    rated = sizes.join(F.broadcast(_by_source(rates, "most double, scale double", spark)), "source")
    expected = F.when(F.col("scale") == 0, F.col("most")).otherwise(F.least(F.col("most"), F.col("scale") * F.pow(F.lit(2.0), (step + 0.5) / SIZE_STEPS * size_power)))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    rated = rated.withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-9)).withColumn("odds", F.col("expected") - F.col("certain")).withColumn("u", uniform)
    # The logarithm of the ranking variable: random odds over inclusion odds. Records without odds never come.
    ranked = F.when(F.col("odds") > 1e-9, F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("odds") / (1 - F.col("odds"))))
    bucket = F.least(F.greatest(F.floor((F.col("rank") + 16) * (RANK_BUCKETS / 32)), F.lit(0)), F.lit(RANK_BUCKETS - 1)).cast("int")
    rated = rated.withColumn("rank", ranked).withColumn("bucket", F.when(F.col("rank").isNotNull(), bucket))
    certain: dict[str, int] = defaultdict(int)
    buckets: dict[str, dict[int, int]] = defaultdict(dict)
    for r in rated.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("certain") * F.col("tokens")).alias("certain")).collect():  # at most targets x RANK_BUCKETS rows
        certain[r["source"]] += r["certain"]
        if r["bucket"] is not None:
            buckets[r["source"]][r["bucket"]] = r["tokens"]
    edges = {}
    for s in able:
        left, edge = goals[s] - certain[s], RANK_BUCKETS
        for bucket in sorted(buckets[s]):
            if buckets[s][bucket] > left:
                edge = bucket
                break
            left -= buckets[s][bucket]
        edges[s] = [edge, float(left)]
    drawn = cut(_below_threshold(rated.join(F.broadcast(_by_source(edges, "edge int, open double", spark)), "source")))
    added, dropped = _fixed(drawn)
    extra = (F.col("extra") | F.col("doc_id").isin(added)) & ~F.col("doc_id").isin(dropped)
    return drawn.select("doc_id", "source", "tokens", "expected", (F.col("certain") + extra.cast("long")).cast("long").alias("copies")).where("copies > 0")


def _wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeat limit by source; the targets are a small table that doesn't grow with the records."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    return {r["source"]: (r["share"], r["most"]) for r in rows.collect()}


def _below_threshold(rated: DataFrame) -> DataFrame:
    """``rated`` with ``extra`` (drawn once more or not) and ``rest``: what is open of the source's goal behind the threshold.

    Buckets below the edge are taken whole; only the records of the edge bucket are put in order.
    """
    inside = F.col("bucket") == F.col("edge")
    order = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = rated.where(inside).select("doc_id", "source", "rank", "tokens", "open").withColumn("upto", F.sum("tokens").over(order)).select("doc_id", (F.col("upto") <= F.col("open")).alias("fits"))
    joined = rated.join(edge, "doc_id", "left")
    return joined.withColumn("extra", F.coalesce(F.when(F.col("bucket").isNull(), False).when(F.col("bucket") < F.col("edge"), True).otherwise(F.col("fits")), F.lit(False)))


def _fixed(drawn: DataFrame, most: int = FIXED) -> tuple[list[int], list[int]]:
    """Which records to add and which to drop so that the sources come nearest to their goals.

    What is open behind the threshold is less than the next record. Of the ``most`` records on either side of the
    threshold at most two are added and one is dropped, those whose sizes together come closest to what is open.
    """
    in_edge = F.sum(F.when((F.col("bucket") == F.col("edge")) & F.col("extra"), F.col("tokens")).otherwise(0))
    gaps = {r["source"]: r["gap"] for r in drawn.groupBy("source").agg((F.first("open") - in_edge).alias("gap")).collect() if r["gap"]}  # one row a target
    near: dict[tuple[str, bool], list[tuple[int, int]]] = defaultdict(list)
    for side, order in ((True, F.col("rank").desc()), (False, F.col("rank"))):
        place = F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_id"))
        side_rows = drawn.where(F.col("rank").isNotNull() & (F.col("extra") == side)).select("source", "doc_id", "tokens", place.alias("place")).where(F.col("place") <= most)
        for r in side_rows.orderBy("source", "place").collect():  # at most targets x most rows
            near[r["source"], side].append((r["doc_id"], r["tokens"]))
    added, dropped = [], []
    for s, gap in sorted(gaps.items()):
        out, back = near[s, False], near[s, True]
        adds = [()] + [(i,) for i in range(len(out))] + [(i, j) for i in range(len(out)) for j in range(i)]
        drops = [()] + [(i,) for i in range(len(back))]
        gained, lost = np.array([sum(out[i][1] for i in x) for x in adds]), np.array([sum(back[i][1] for i in x) for x in drops])
        miss = np.abs(gap - (gained[:, None] - lost[None, :]))
        a, d = divmod(int(miss.argmin()), len(drops))
        added += [out[i][0] for i in adds[a]]
        dropped += [back[i][0] for i in drops[d]]
    return added, dropped


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, reached_share, tokens, records, most_copies, max_repeats``: what the mixture reached beside its targets."""
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("records"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens")).first()[0] or 1
    joined = wanted.join(per, "source", "left")
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
