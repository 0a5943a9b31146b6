"""The most similar vectors of every vector, by shifted space-filling curves.

The vectors of a model are turned to unit length and projected several times onto a few orthogonal directions, each time
others of a random basis. Each projection, shifted by a random amount, is put on a Hilbert curve; the rows are
range-partitioned by the position on the curve, and every row is compared exactly with the ``width`` rows on either side.
Where a window reaches over the end of a partition, the edges of both meet again at their seam, so the neighbours found
don't depend on how the rows are partitioned. The best of all orderings are merged and ranked again. Rows of equal
direction are one class on the way and are spread out again at the end, so a group of copies of any size costs one row
and loses no neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.core.storage import cut

DIMENSIONS = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``cells`` (whole numbers below ``2**bits``; columns times bits at most 63)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections, from the coarsest level down
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            x[0] = np.where(hit, x[0] ^ low, x[0])
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(units: np.ndarray, ordering: int, axes: int, bits: int) -> np.ndarray:
    """Position of each unit vector on the curve of one ordering: own directions, own shift.

    Consecutive orderings take their directions from one random basis as long as it lasts, so that together they see
    every dimension.
    """
    size = units.shape[1]
    per_basis = max(1, size // axes)
    basis, _ = np.linalg.qr(np.random.default_rng(1000 + ordering // per_basis).standard_normal((size, size)))
    first = ordering % per_basis * axes
    shift = np.random.default_rng(2000 + ordering).random(axes)
    # Components of unit vectors in n dimensions are about normal with deviation n ** -0.5; the normal's
    # distribution function spreads them evenly over the cells.
    spread = 1 / (1 + np.exp(-1.702 * (units @ basis[:, first : first + axes]) * np.sqrt(size) * 0.75))
    cells = np.clip((spread * 0.9 + shift * 0.1) * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_keys(cells, bits)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _raw(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as stored."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(len(column), -1)


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors, in double precision, of stored single-precision ones."""
    m = raw.astype(np.float64)
    return m / np.linalg.norm(m, axis=1)[:, None]


def _binary(m: np.ndarray) -> pa.Array:
    """One binary value a row of ``m``."""
    size = m.shape[1] * m.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _usable(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _column(b, "vector")
            lengths = np.array([-1 if n is None else n for n in vectors.value_lengths().to_pylist()])
            chosen = pa.array(np.flatnonzero(lengths == dimensions))
            values = vectors.take(chosen).flatten()
            m = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.linalg.norm(m, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            chosen, m, norm = chosen.filter(pa.array(good)), m[good], norm[good]
            # Directions that agree to 6 decimals have a similarity of 1 to 9 decimals.
            rounded = np.round(m / norm[:, None], 6) + 0.0
            classes = pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rounded], pa.binary())
            yield pa.RecordBatch.from_arrays([_column(b, "id").take(chosen), _column(b, "model").take(chosen), classes, _binary(m.astype(np.float32))], ["id", "model", "class", "raw"])

    return run


def _keyed(orderings: int, axes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            units = _units(_raw(_column(b, "raw")))
            for o in range(orderings):
                yield pa.RecordBatch.from_arrays([_column(b, "model"), pa.array(np.full(b.num_rows, o, np.int32)), pa.array(curve_keys(units, o, axes, bits)), _column(b, "id"), _column(b, "raw")], ["model", "ordering", "key", "id", "raw"])

    return run


BILLION = 1_000_000_000
FOUND = "model string, id long, near array<long>, lost array<int>, seam int, side int, place int, ordering int, raw binary"


def _best(rows: np.ndarray, ids: np.ndarray, lost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows, ids, lost`` of the ``k`` best of every row: those that lost least, ties to the smaller id; repeats count once."""
    order = np.lexsort((ids, lost, rows))
    rows, ids, lost = rows[order], ids[order], lost[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, ids, lost = rows[fresh], ids[fresh], lost[fresh]
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
    kept = place < k
    return rows[kept], ids[kept], lost[kept]


def _chosen(sims: np.ndarray, k: int, group: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries that may be among the ``k`` largest of their row, given single precision; -2 is none."""
    whole = sims.shape[1] // group * group
    peaks = sims[:, :whole].reshape(len(sims), group, -1).max(axis=1) if whole else np.empty((len(sims), 0), sims.dtype)
    peaks = np.concatenate([peaks, sims[:, whole:]], axis=1)
    # As many groups as k have a peak of at least this much, so the k largest entries have it too.
    least = np.partition(peaks, peaks.shape[1] - k, axis=1)[:, peaks.shape[1] - k] if peaks.shape[1] > k else np.full(len(sims), -1.5, sims.dtype)
    return np.divmod(np.flatnonzero(sims >= np.maximum(least - np.float32(1e-5), np.float32(-1.5))[:, None]), sims.shape[1])


def _nearest_in(left: np.ndarray, right: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_best`` of the pairs that ``sims`` (single precision) leaves to choose from, by their exact similarity."""
    rows, columns = _chosen(sims, k)
    exact = np.concatenate([np.einsum("ij,ij->i", left[rows[a : a + 100_000]], right[columns[a : a + 100_000]]) for a in range(0, max(1, len(rows)), 100_000)])
    return _best(rows, ids[columns], np.round((1 - exact) * BILLION).astype(np.int32), k)


def _lists(model: str, ids: np.ndarray, rows: np.ndarray, near: np.ndarray, lost: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.searchsorted(rows, np.arange(len(ids) + 1)).astype(np.int32))
    empty = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())]
    columns = [pa.array([model] * len(ids), pa.string()), pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(near)), pa.ListArray.from_arrays(offsets, pa.array(lost)), *empty]
    return pa.RecordBatch.from_arrays(columns, ["model", "id", "near", "lost", "seam", "side", "place", "ordering", "raw"])


def _windows(width: int, k: int, block: int = 256):
    """The best ``k`` of the ``width`` rows on either side, for rows that come sorted by model, ordering, key and id.

    Besides, the rows of either edge of the partition (``place``: how far from the end, from 0) for its seams.
    """

    def compare(model: str, ids: np.ndarray, raw: np.ndarray, first: int, last: int) -> Iterator[pa.RecordBatch]:
        units = _units(raw)
        m = units.astype(np.float32)
        for a in range(first, last, block):
            b = min(last, a + block)
            lo, hi = max(0, a - width), min(len(ids), b + width)
            sims = m[a:b] @ m[lo:hi].T
            here = np.arange(a, b)[:, None]
            for c, d in ((lo, min(hi, max(lo, b - width))), (max(lo, min(hi, a + width + 1)), hi)):  # columns that lie outside of some rows' windows
                if c < d:
                    sims[:, c - lo : d - lo][np.abs(here - np.arange(c, d)[None, :]) > width] = -2
            sims[np.arange(b - a), np.arange(a - lo, b - lo)] = -2
            yield _lists(model, ids[a:b], *_nearest_in(units[a:b], units[lo:hi], ids[lo:hi], sims, k))

    def edge(model: str, ordering: int, ids: np.ndarray, raw: np.ndarray, seam: int, side: int) -> pa.RecordBatch:
        n = len(ids)
        place = np.arange(n, dtype=np.int32) if side else np.arange(n - 1, -1, -1, dtype=np.int32)
        full = [pa.array(np.full(n, x, np.int32)) for x in (seam, side)]
        none = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
        columns = [pa.array([model] * n, pa.string()), pa.array(ids), *none, *full, pa.array(place), pa.array(np.full(n, ordering, np.int32)), _binary(raw)]
        return pa.RecordBatch.from_arrays(columns, ["model", "id", "near", "lost", "seam", "side", "place", "ordering", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group: tuple[str, int] | None = None
        ids, raw, done, fresh, opening = np.empty(0, np.int64), np.empty((0, 0), np.float32), 0, True, True
        for b in batches:
            models, orderings = _column(b, "model"), _column(b, "ordering").to_numpy()
            codes = models.dictionary_encode().indices.to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(codes) != 0) | (np.diff(orderings) != 0)) + 1, b.num_rows] if b.num_rows else np.zeros(1, int)
            all_ids, all_raw = (_column(b, "id").to_numpy(), _raw(_column(b, "raw"))) if b.num_rows else (ids, raw)
            for c, d in zip(cuts[:-1], cuts[1:], strict=True):
                now = (models[int(c)].as_py(), int(orderings[c]))
                if group is not None and now != group:
                    if opening:
                        yield edge(*group, ids[:width], raw[:width], part - 1, 1)
                    yield from compare(group[0], ids, raw, done, len(ids))
                    fresh, opening = True, False
                if fresh:
                    ids, raw, done, fresh, group = all_ids[c:d], all_raw[c:d], 0, False, now
                else:
                    ids, raw = np.concatenate([ids, all_ids[c:d]]), np.concatenate([raw, all_raw[c:d]])
                if len(ids) - done > 8 * width:
                    if opening:
                        yield edge(*group, ids[:width], raw[:width], part - 1, 1)
                        opening = False
                    yield from compare(group[0], ids, raw, done, len(ids) - width)
                    done = len(ids) - width
                    drop = max(0, done - width)
                    ids, raw, done = ids[drop:], raw[drop:], done - drop
        if group is not None:
            if opening:
                yield edge(*group, ids[:width], raw[:width], part - 1, 1)
            yield edge(*group, ids[-width:], raw[-width:], part, 0)
            yield from compare(group[0], ids, raw, done, len(ids))

    return run


def _seams(width: int, k: int, block: int = 256):
    """The pairs of a window that lie on both sides of a seam, for the edges that meet there."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("place", "ascending")]).combine_chunks()
        side, place, ids = (rows[c].to_numpy() for c in ("side", "place", "id"))
        units = _units(_raw(rows["raw"].chunk(0)))
        m, n = units.astype(np.float32), int((side == 0).sum())
        out = []
        ends = [(0, n), (n, len(ids))]
        same = 0 < n < len(ids) and rows["model"][0] == rows["model"][n] and rows["ordering"][0] == rows["ordering"][n]
        for (first, last), (c, d) in ((ends[0], ends[1]), (ends[1], ends[0])) if same else ():
            for a in range(first, last, block):
                b = min(last, a + block)
                reach = c + min(d - c, max(0, width - int(place[a])))
                sims = m[a:b] @ m[c:reach].T
                sims[place[a:b, None] + place[None, c:reach] + 1 > width] = -2
                if reach > c:
                    out.append(_lists(rows["model"][0].as_py(), ids[a:b], *_nearest_in(units[a:b], units[c:reach], ids[c:reach], sims, k)).select(["model", "id", "near", "lost"]))
        schema = pa.schema([("model", pa.string()), ("id", pa.int64()), ("near", pa.list_(pa.int64())), ("lost", pa.list_(pa.int32()))])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    return run


def _merge(k: int):
    """The best ``k`` distinct neighbours of every row over all orderings, from all its lists one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, lost = _column(b, "near"), _column(b, "lost")
            rows = np.repeat(np.arange(b.num_rows), near.value_lengths().to_numpy())
            rows, ids, away = _best(rows, near.flatten().to_numpy(), lost.flatten().to_numpy(), k)
            offsets = pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([_column(b, "model"), _column(b, "id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(away))], ["model", "id", "near", "lost"])

    return run


def _rows(vectors: DataFrame, id_column: str, dimensions: int) -> DataFrame:
    """``id, model, class, raw`` of the usable vectors; a row given twice comes twice."""
    given = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col("model").cast("string"), F.lit("")).alias("model"), F.col("vector").cast("array<float>").alias("vector"))
    return given.mapInArrow(_usable(dimensions), "id long, model string, class binary, raw binary")


def most_similar(
    vectors: DataFrame, id_column: str = "chunk_id", k: int = 10, orderings: int = 8, axes: int = 6, bits: int = 8, width: int = 4000, dimensions: int = DIMENSIONS, rows_per_task: int = 60_000
) -> DataFrame:
    """``model, id, near``: for every usable vector the array of its ``k`` most similar ones as ``(id, similarity)``, best first.

    Only vectors of one model are compared; similarities that agree to 9 decimals are tied and go to the smaller id.
    Null, all-zero and not finite vectors, and those not ``dimensions`` long, take no part; a null id neither; a row
    given twice counts once (of different vectors of one id, one is taken, always the same); a null model is a model of
    its own; an empty table gives an empty one. ``rows_per_task`` must be well above ``width``.
    """
    usable = cut(_rows(vectors, id_column, dimensions))
    # Classes of equal direction. A class of one is its own; of larger ones the k + 1 smallest ids are all that can be a neighbour.
    member = usable.groupBy("model", "id").agg(F.min("class").alias("class"))
    order = Window.partitionBy("model", "class").orderBy("id")
    smallest = member.select("model", "class", "id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    classes = smallest.groupBy("model", "class").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("members"))
    sizes = member.groupBy("model", "class").agg(F.count("*").alias("size"))
    raws = usable.groupBy("model", "class").agg(F.min_by("raw", "id").alias("raw"))
    reps = cut(classes.join(sizes, ["model", "class"]).join(raws, ["model", "class"]))
    tasks = max(1, -(-reps.count() * orderings // rows_per_task))
    keyed = reps.select("id", "model", "raw").mapInArrow(_keyed(orderings, axes, bits), "model string, ordering int, key long, id long, raw binary")
    laid = keyed.repartitionByRange(int(tasks), "model", "ordering", "key", "id").sortWithinPartitions("model", "ordering", "key", "id")
    found = cut(laid.mapInArrow(_windows(width, k), FOUND))
    over = found.where("seam is not null").select("model", "id", "seam", "side", "place", "ordering", "raw").groupBy("seam").applyInArrow(_seams(width, k), "model string, id long, near array<long>, lost array<int>")
    near = found.where("seam is null").select("model", "id", "near", "lost").unionByName(over)
    gathered = near.groupBy("model", "id").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("lost")).alias("lost"))
    merged = gathered.mapInArrow(_merge(k), "model string, id long, near array<long>, lost array<int>")
    # Spread classes out: a class's neighbours are its own other members and those of the nearest classes. Most classes have one member.
    several = reps.where("size > 1")
    nearest = merged.select("model", F.col("id").alias("rep"), F.explode(F.arrays_zip("near", "lost")).alias("pair")).select("model", "rep", F.col("pair.near").alias("other"), F.col("pair.lost").alias("lost"))
    own = several.select("model", F.col("id").alias("rep"), F.col("id").alias("other"), F.lit(0).alias("lost"))
    members = several.select("model", F.col("id").alias("other"), "members")
    more = nearest.unionByName(own).join(members, ["model", "other"]).select("model", "rep", F.expr("transform(members, m -> named_struct('lost', lost, 'id', m))").alias("pairs")).groupBy("model", "rep").agg(F.flatten(F.collect_list("pairs")).alias("more"))
    pairs = F.expr("array_append(transform(arrays_zip(lost, near), x -> named_struct('lost', x.lost, 'id', x.near)), named_struct('lost', 0, 'id', rep))")
    listed = merged.withColumnRenamed("id", "rep").join(more, ["model", "rep"], "left").select("model", "rep", pairs.alias("pairs"), "more")
    every = F.when(F.col("more").isNull(), F.col("pairs")).otherwise(F.array_distinct(F.concat("pairs", "more")))
    lists = listed.select("model", "rep", F.slice(F.sort_array(every), 1, k + 1).alias("pairs"))
    # Large classes are cut into parts of 50 000 members, so that no task gets a whole one.
    salted = lists.join(reps.select("model", F.col("id").alias("rep"), "class", "size"), ["model", "rep"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / 50_000).cast("int"))))
    parts = sizes.select("model", "class", F.floor(F.col("size") / 50_000 + 1).cast("long").alias("parts")).where("parts > 1")
    placed = member.join(parts, ["model", "class"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    spread = placed.join(salted.select("model", "class", "part", "pairs"), ["model", "class", "part"])
    others = F.slice(F.filter("pairs", lambda x: x["id"] != F.col("id")), 1, k)
    return spread.select("model", "id", F.transform(others, lambda x: F.struct(x["id"].alias("id"), (1 - x["lost"] / F.lit(BILLION)).alias("similarity"))).alias("near"))


def similar_pairs(vectors: DataFrame, least: float = 0.9, **parameters) -> DataFrame:
    """``a, b``: the pairs, a below b, of which one is among the other's most similar and whose similarity is at least ``least``."""
    near = most_similar(vectors, **parameters).select("id", F.explode("near").alias("other")).where(F.round(F.col("other.similarity"), 9) >= least)
    return near.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct()


def _blocks(rows: int):
    """Blocks of at most ``rows`` rows of one model: their ids and their vectors one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = np.array(_column(b, "model").to_pylist(), dtype=object)
            for model in sorted(set(models)):
                at = np.flatnonzero(models == model)
                ids, raw = _column(b, "id").to_numpy()[at], _raw(_column(b, "raw"))[at]
                for a in range(0, len(at), rows):
                    part = ids[a : a + rows]
                    yield pa.RecordBatch.from_arrays([pa.array([model], pa.string()), pa.array([part.tolist()], pa.list_(pa.int64())), pa.array([raw[a : a + rows].tobytes()], pa.binary())], ["model", "ids", "raws"])

    return run


def _exact(k: int, dimensions: int):
    """Exact best ``k`` of every asked vector within each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asked, ids = np.array(r["asked"]), np.array(r["ids"])
                left, right = (_units(np.frombuffer(r[c], np.float32).reshape(-1, dimensions)) for c in ("asked_raws", "raws"))
                sims = (left @ right.T).astype(np.float32)
                sims[asked[:, None] == ids[None, :]] = -2
                rows, near, lost = _nearest_in(left, right, ids, sims, k)
                yield pa.RecordBatch.from_arrays([pa.array([r["model"]] * len(rows), pa.string()), pa.array(asked[rows]), pa.array(near), pa.array(lost)], ["model", "id", "other", "lost"])

    return run


def recall(vectors: DataFrame, id_column: str = "chunk_id", k: int = 10, every: int = 100, block: int = 2000, **parameters) -> DataFrame:
    """``model, queries, recall``: how many of the exact ``k`` nearest of every hundredth id the curves have found.

    The queries are those with an id divisible by ``every``, compared with all rows, ``block`` of them at a time. A model
    without such an id has no queries and a null recall.
    """
    dimensions = parameters.get("dimensions", DIMENSIONS)
    found = most_similar(vectors, id_column, k, **parameters).where(F.col("id") % every == 0).select("model", "id", F.explode("near").alias("n")).select("model", "id", F.col("n.id").alias("other"))
    usable = cut(_rows(vectors, id_column, dimensions).groupBy("model", "id").agg(F.min_by("raw", "class").alias("raw")))
    packed = "model string, ids array<long>, raws binary"
    rows = usable.mapInArrow(_blocks(10 * block), packed)
    chosen = usable.where(F.col("id") % every == 0)
    count = chosen.count()
    asked = chosen.repartition(max(1, -(-count // block))).mapInArrow(_blocks(block), packed).select("model", F.col("ids").alias("asked"), F.col("raws").alias("asked_raws"))
    # The stated queries against all rows, in blocks: each pair of blocks is one row, and no model meets in one task.
    near = rows.join(cut(asked).hint("shuffle_replicate_nl"), "model").mapInArrow(_exact(k, dimensions), "model string, id long, other long, lost int")
    order = Window.partitionBy("model", "id").orderBy("lost", "other")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("model", "id", "other")
    hits = best.join(found.withColumn("hit", F.lit(1)), ["model", "id", "other"], "left")
    measured = hits.groupBy("model").agg(F.countDistinct("id").alias("queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 4).alias("recall"))
    return usable.select("model").distinct().join(measured, "model", "left").select("model", F.coalesce("queries", F.lit(0)).alias("queries"), "recall")
