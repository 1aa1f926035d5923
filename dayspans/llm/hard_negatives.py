"""Hard negatives by segment summaries.

A vector is cut into segments; of each its mean and deviation are stored. A segment's inner product lies within its length
times the product of the means plus or minus the product of the deviations, so the sums over the segments bound a score
from both sides, and halved segments bound it closer. Rows are sorted by label and direction into cells of blocks, and a
cell has the box of its summaries. A block of anchors goes only to cells whose box lets some score in; there the coarse
bounds, then the finer ones, leave few pairs to score exactly. The same search runs twice: for the best rows of an anchor's
own label (its positives), then, with the window of scores that each positive allows, for those of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stash
from ._vectors import LARGEST, in_groups, largest, matrix, scaled, usable

#: Segments of the bounds, coarse to fine; each divides the next.
SEGMENTS = (4, 16)
#: Bytes of the vectors (64-bit numbers) in a block of rows and of anchors; blocks of a cell, at least and at most; cells beyond which cells grow.
BLOCK_BYTES, ANCHOR_BYTES, CELL, MOST_CELL, CELLS = 1 << 20, 1 << 19, 8, 256, 2_048
#: Relative slack of the bounds, far above the rounding errors of summaries in 32 bits.
SLACK = 1e-5

PACKED = "part int, no long, rows binary, ids binary, known binary, labels binary, kind string, x binary, means binary, deviations binary"
BOX = "low_label long, high_label long, low array<double>, high array<double>, deviation array<double>"
FOUND = "row long, nth int, score long, known boolean, vec_id long"


class Side(NamedTuple):
    """A block of rows: numbers, ids (and whether they are known), labels, vectors, and summaries at the finest level."""

    rows: object
    ids: object
    known: object
    labels: object
    x: object
    means: object
    deviations: object


def padded(dims: int) -> int:
    """Components after zeros are added to make all segments equally long."""
    return max(1, -(-dims // SEGMENTS[-1])) * SEGMENTS[-1]


def summaries(x, segments: int):
    """Mean and deviation of each segment of each row."""
    parts = x.reshape(len(x), segments, -1).astype(float)
    return parts.mean(2), parts.std(2)


def coarser(means, deviations, segments: int):
    """The summaries of longer segments from those of the shorter ones that make them up."""
    import numpy as np

    m = means.reshape(len(means), segments, -1).astype(float)
    squares = (deviations.reshape(m.shape).astype(float) ** 2 + m**2).mean(2)
    m = m.mean(2)
    return m, np.sqrt(np.maximum(squares - m**2, 0))


def packed_side(side: Side) -> dict:
    import numpy as np

    kind = "<i4" if not len(side.x) or np.abs(side.x).max() < 1 << 31 else "<i8"
    return {"rows": side.rows.astype("<i8").tobytes(), "ids": side.ids.astype("<i8").tobytes(), "known": side.known.tobytes(), "labels": side.labels.astype("<i8").tobytes(), "kind": kind, "x": side.x.astype(kind).tobytes(), "means": side.means.astype("<f4").tobytes(), "deviations": side.deviations.astype("<f4").tobytes()}


def unpacked(row, dims: int) -> Side:
    import numpy as np

    read = lambda name, kind: np.frombuffer(row[name], kind)
    fine = lambda name: read(name, "<f4").reshape(-1, SEGMENTS[-1])
    return Side(read("rows", "<i8"), read("ids", "<i8"), read("known", bool), read("labels", "<i8"), read("x", row["kind"]).reshape(-1, padded(dims)).astype(np.int64), fine("means"), fine("deviations"))


def merged(sides: list[Side], size: int) -> Iterator[Side]:
    """The same rows in order, in blocks of about ``size``: short blocks, as of short partitions, are put together."""
    import numpy as np

    held: list[Side] = []
    for i, side in enumerate(sides):
        held.append(side)
        if i + 1 == len(sides) or sum(len(h.x) for h in held) + len(sides[i + 1].x) > size:
            yield held[0] if len(held) == 1 else Side(*[np.concatenate(parts) for parts in zip(*held)])
            held = []


def box(side: Side) -> dict:
    """Bounds of a block's labels and of its coarse summaries."""
    m, d = coarser(side.means, side.deviations, SEGMENTS[0])
    return {"low_label": int(side.labels.min()), "high_label": int(side.labels.max()), "low": m.min(0).tolist(), "high": m.max(0).tolist(), "deviation": d.max(0).tolist()}


def blocks(v: DataFrame, dims: int, size: int, extra: str = "", also=None) -> DataFrame:
    """Blocks of at most ``size`` rows in the order of the partitions, with their boxes and their partition's number.

    ``also`` makes further columns, of the types in ``extra``, from the batch's columns after the first four.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, held, made_so_far = TaskContext.get().partitionId(), [], 0

        def made(t: pa.Table):
            nonlocal made_so_far
            b = t.combine_chunks().to_batches()[0]
            x = np.pad(matrix(b.column(3), dims), ((0, 0), (0, padded(dims) - dims)))
            ids = b.column(1)
            side = Side(b.column(0).to_numpy(), ids.fill_null(0).to_numpy(), ~np.asarray(ids.is_null()), b.column(2).to_numpy(), x, *summaries(x, SEGMENTS[-1]))
            made_so_far += 1
            row = {"part": part, "no": (part << 32) + made_so_far, **packed_side(side), **box(side), **(also(b) if also else {})}
            whole = pa.RecordBatch.from_pylist([row])
            return whole.set_column(0, "part", whole.column(0).cast(pa.int32()))

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                t = pa.Table.from_batches(held)
                yield made(t.slice(0, size))
                held = t.slice(size).to_batches()
        if sum(map(len, held)):
            yield made(pa.Table.from_batches(held))

    return v.mapInArrow(run, f"{PACKED}, {BOX}{extra}")


class Search:
    """The best ``k`` rows so far of each window (low, high) of scores of each anchor of a block.

    ``low`` and ``high``: a row per anchor, a column per window. ``same``: whether rows of the anchor's label are sought,
    or of others.
    """

    def __init__(self, q: Side, low, high, k: int, same: bool):
        import numpy as np

        self.q, self.low, self.high, self.k, self.same = q, low, high, k, same
        self.least = np.full(low.shape, -np.inf)
        self.length = np.sqrt((q.x.astype(float) ** 2).sum(1))
        self.levels = {s: coarser(q.means, q.deviations, s) for s in SEGMENTS}
        self.found = [np.empty(0, np.int64)] * 4  # window's number, score, whether the id is unknown, id

    def range(self):
        """The scores that an anchor can still use: from the lowest window's floor or third best to the highest one's top."""
        import numpy as np

        open_ = self.low <= self.high
        floor = np.where(open_, np.maximum(self.low.astype(float), self.least), np.inf).min(1)
        return floor, np.where(open_, self.high.astype(float), -np.inf).max(1)

    def reaches(self, low, high, deviation, longest) -> object:
        """Which anchors may use a row whose coarse summaries lie in a box."""
        import numpy as np

        (m, d), (floor, top) = self.levels[SEGMENTS[0]], self.range()
        size = self.q.x.shape[1] // SEGMENTS[0]
        most, least = np.maximum(m * low, m * high).sum(1), np.minimum(m * low, m * high).sum(1)
        by = (d * deviation).sum(1)
        slack = SLACK * (1 + self.length * longest)
        return ((most + by) * size + slack >= floor) & ((least - by) * size - slack <= top)

    def meet(self, c: Side, given: dict) -> None:
        """Take in a block of rows. Scores are exact: as doubles while none can reach 2^53, else as 64-bit numbers."""
        import numpy as np

        length = np.sqrt((c.x.astype(float) ** 2).sum(1))
        rows = np.flatnonzero(self.reaches(np.array(given["low"]), np.array(given["high"]), np.array(given["deviation"]), length.max()))
        cols = np.arange(len(length))
        floor, top = self.range()
        open_ = (self.q.labels[rows][:, None] == c.labels[None, :]) == self.same
        open_ &= ~(c.known[None, :] & (c.ids[None, :] == self.q.ids[rows][:, None]))
        for s in SEGMENTS:
            if not len(rows) or not len(cols):
                return
            (m, d), (cm, cd), size = self.levels[s], coarser(c.means[cols], c.deviations[cols], s), self.q.x.shape[1] // s
            middle, by = m[rows] @ cm.T * size, d[rows] @ cd.T * size
            by += SLACK * (1 + np.outer(self.length[rows], length[cols]))
            open_ &= (middle + by >= floor[rows][:, None]) & (middle - by <= top[rows][:, None])
            a, b = open_.any(1), open_.any(0)
            rows, cols, open_ = rows[a], cols[b], open_[a][:, b]
        if not len(rows):
            return
        kind = float if self.length.max() * length.max() < 2.0**52 else np.int64
        scores = (self.q.x[rows].astype(kind) @ c.x[cols].astype(kind).T).astype(np.int64)
        for w in range(self.low.shape[1]):
            floor_w = np.maximum(self.low[rows, w].astype(float), self.least[rows, w])
            hit = open_ & (scores >= floor_w[:, None]) & (scores >= self.low[rows, w][:, None]) & (scores <= self.high[rows, w][:, None])
            at, to = np.nonzero(hit)
            if len(at):
                self.add(rows[at] * self.low.shape[1] + w, scores[at, to], c.known[cols[to]], c.ids[cols[to]])

    def add(self, window, score, known, ids) -> None:
        """Merge rows into the best ones: by score, then by id, null ids last."""
        import numpy as np

        merged = [np.concatenate(x) for x in zip(self.found, (window, score, (~known).astype(np.int64), np.where(known, ids, 0)))]
        order = np.lexsort((merged[3], merged[2], -merged[1], merged[0]))
        merged = [x[order] for x in merged]
        first = np.flatnonzero(np.diff(merged[0], prepend=-1))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        self.found = [x[place < self.k] for x in merged]
        full = place == self.k - 1
        self.least.reshape(-1)[merged[0][full]] = merged[1][full]

    def frame(self) -> pd.DataFrame:
        import pandas as pd

        window, score, unknown, ids = self.found
        wide = self.low.shape[1]
        return pd.DataFrame({"row": self.q.rows[window // wide], "nth": (window % wide + 1).astype("i4"), "score": score, "known": unknown == 0, "vec_id": ids})


def searched(asked: DataFrame, cells: DataFrame, dims: int, k: int, windows: int, same: bool, size: int, q_size: int) -> DataFrame:
    """FOUND rows: the best ``k`` rows of every window within each cell. ``asked``: blocks of anchors with low and high (packed 64-bit numbers)."""
    import numpy as np

    per = cells.groupBy("part").agg(F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"), *[F.array(*[f(F.col(c)[i]) for i in range(SEGMENTS[0])]).alias(c) for c, f in (("low", F.min), ("high", F.max), ("deviation", F.max))])
    boxes = [r.asDict() for r in per.collect()]  # one per cell: about CELLS, more only when cells have MOST_CELL blocks

    def opened(row) -> Search:
        q = unpacked(row, dims)
        low, high = (np.frombuffer(row[c], "<i8").reshape(-1, windows) for c in ("lowest", "highest"))
        return Search(q, low, high, k, same)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = padded(dims) // SEGMENTS[0]
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                s, labels = opened(row), np.frombuffer(row["labels"], "<i8")
                to = []
                for b in boxes:
                    low, high, deviation = (np.array(b[c]) for c in ("low", "high", "deviation"))
                    longest = float(np.sqrt(side * (np.maximum(low**2, high**2) + deviation**2).sum()))
                    fits = (labels >= b["low_label"]) & (labels <= b["high_label"]) if same else (labels != b["low_label"]) | (b["low_label"] != b["high_label"])
                    if (fits & s.reaches(low, high, deviation, longest)).any():
                        to.append(b["part"])
                if to:
                    one = pa.Table.from_batches([batch.slice(i, 1)])
                    for cell in to:
                        yield from one.append_column("cell", pa.array([cell], pa.int32())).to_batches()

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        out = []
        met = list(merged([unpacked(given, dims) for given in c.sort_values("no").to_dict("records")], size))
        boxes_met = [box(side) for side in met]
        blocks_asked = q.sort_values("no").to_dict("records")
        low, high = (np.concatenate([np.frombuffer(r[c], "<i8").reshape(-1, windows) for r in blocks_asked]) for c in ("lowest", "highest"))
        at = 0
        for side in merged([unpacked(r, dims) for r in blocks_asked], q_size):
            s = Search(side, low[at : at + len(side.x)], high[at : at + len(side.x)], k, same)
            at += len(side.x)
            for other, given in zip(met, boxes_met):
                s.meet(other, given)
            out.append(s.frame())
        return pd.concat(out, ignore_index=True)

    kept = asked.drop("low", "high", "deviation", "low_label", "high_label")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    routed = stash(kept.mapInArrow(route, f"{schema}, cell int"), "negatives-routed")
    wanted = routed.select(F.col("cell").alias("part"), F.col("part").alias("group")).distinct()
    sent = cells.join(wanted, "part").withColumnRenamed("part", "cell")
    return routed.groupBy("cell", "part").cogroup(sent.groupBy("cell", "group")).applyInPandas(run, FOUND)


def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows per key over all cells, numbered."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("known"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, *, positives: int = 5, negatives: int = 3, every: int = 50, least: int = 50, most: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are floor(``scale`` * x), scores inner products. Anchors are the rows whose id is divisible by ``every``; an
    anchor's ``positives`` are its best other rows of its label; for each, its ``negatives`` are the best rows of other
    labels with ``least`` * positive score <= 100 * score <= ``most`` * positive score. Ties go to the smaller id, null ids
    last; where there are fewer, all are given, and an anchor without any gives no row.

    Rows with a null label, a null vector or a null or non-finite component take no part; shorter vectors count as filled
    up with zeros; labels are whole numbers. A row with a null id is never an anchor. Rows with an anchor's own id are not
    its positives or negatives; repeated rows are candidates each, and a repeated anchor gives its rows again. An empty
    table gives no rows; other columns are not read. Vectors so long that 100 scores may not fit 64 bits raise a ValueError.
    """
    spark = vectors.sparkSession
    v = vectors.where(usable(F.col(vector_col)) & F.col(label_col).isNotNull())
    v = v.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vector_col), scale).alias("x"), largest(F.col(vector_col), scale).alias("largest"))
    v = stash(v, "negatives-vectors")
    is_anchor = F.col("vec_id") % every == 0
    n, asked_n, dims, longest = v.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0.0))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked_n or not dims:
        return spark.createDataFrame([], result)
    if longest**2 * dims * 128 >= 2.0 * LARGEST:
        raise ValueError(f"scores may not fit: components of up to {longest:.6g} after scaling by {scale}")
    wide = padded(dims)
    size, q_size = max(1, BLOCK_BYTES // (8 * wide)), max(1, ANCHOR_BYTES // (8 * wide))
    number = -(-n // size)
    cells_n, q_parts = max(1, -(-number // max(CELL, min(MOST_CELL, number // CELLS)))), max(1, -(-asked_n // (q_size * CELL)))
    # Rows of like direction, by the signs of the coarse segments' sums, lie in the same cells.
    part = wide // SEGMENTS[0]
    sign = sum(((F.aggregate(F.slice("x", i * part + 1, part), F.lit(0).cast("long"), lambda a, c: a + c) > 0).cast("int") * (1 << i) for i in range(SEGMENTS[0])), F.lit(0))
    order = ["label", "sign", "vec_id", "row"]
    sorted_by = lambda df, parts: df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    v = v.withColumn("sign", sign)
    ahead = -(-n // cells_n), -(-asked_n // q_parts)  # rows of a cell and of a group of anchors, about
    cells = in_groups(stash(blocks(sorted_by(v, cells_n).select("row", "vec_id", "label", "x"), dims, size), "negatives-cells"), ahead[0])

    def whole(batch: pa.RecordBatch) -> dict:
        import numpy as np

        return {"lowest": np.full(len(batch), -(1 << 62), "<i8").tobytes(), "highest": np.full(len(batch), 1 << 62, "<i8").tobytes()}

    def windows(batch: pa.RecordBatch) -> dict:
        """From each positive's score p: the whole numbers s with least * p <= 100 * s <= most * p; empty beyond the last positive."""
        import numpy as np

        low, high = np.full((len(batch), positives), 1, "<i8"), np.zeros((len(batch), positives), "<i8")
        for i, scores in enumerate(batch.column(4).to_pylist()):
            for j, p in enumerate(scores):
                low[i, j], high[i, j] = -(-least * p // 100), most * p // 100
        return {"lowest": low.tobytes(), "highest": high.tobytes()}

    bounds = ", lowest binary, highest binary"
    anchors = v.where(is_anchor)
    asked = in_groups(stash(blocks(sorted_by(anchors, q_parts).select("row", "vec_id", "label", "x"), dims, q_size, bounds, whole), "negatives-anchors"), ahead[1])
    best = stash(top(searched(asked, cells, dims, positives, 1, True, size, q_size), ["row"], positives).select("row", F.col("rank").alias("nth"), "known", "vec_id", "score"), "negatives-positives")
    given = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score"))), lambda s: s["score"]).alias("scores"))
    again = sorted_by(anchors.join(given, "row"), q_parts).select("row", "vec_id", "label", "x", "scores")
    asked = in_groups(stash(blocks(again, dims, q_size, bounds, windows), "negatives-windows"), ahead[1])
    found = top(searched(asked, cells, dims, negatives, positives, False, size, q_size), ["row", "nth"], negatives)
    id_of = lambda alias: F.when(F.col("known"), F.col("vec_id")).alias(alias)
    pairs = best.select("row", "nth", id_of("positive_id"), F.col("score").alias("positive_score"))
    return found.select("row", "nth", "rank", id_of("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "nth"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, for each of its five positives; a seventh of the rows moves to the next label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.select("vec_id", moved.alias("label"), "embedding"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND p.nth <= 5 AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
