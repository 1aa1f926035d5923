"""Exact top-k inner products, vectors by descending length, with rotated partial sums and Cauchy-Schwarz bounds.

The second-moment matrix of all vectors, summed up in the tasks, gives the rotation (its singular vectors) that puts
most of every inner product into the first coordinates. Vectors are dealt by descending length into blocks of bounded
bytes. The block of the longest ones gives every query a first threshold. Then each block of queries goes to the cells of
blocks, longest first, whose longest vector is long enough for one of its thresholds; a vector whose
partial sum plus the product of the remaining lengths stays below a query's threshold is left out, and the rest are
scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stash
from ._vectors import in_groups

#: Bytes of the vectors in one block of candidates, and in one block of queries; blocks of candidates that one task takes, about.
BLOCK_BYTES, QUERY_BYTES, CELL = 1 << 20, 1 << 21, 32
#: Leading rotated coordinates of the partial sums, as a share of all.
LEADING = 0.25
#: Relative slack of the bounds, far above rounding errors of the rotated sums.
SLACK = 1e-6


def prepared(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x, norm): whole-number vectors and their squared lengths, without null or non-finite ones."""
    whole = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale))
    fine = F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    v = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))
    return v.withColumn("norm", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def moments(v: DataFrame, dims: int):
    """The second-moment matrix of all vectors: every task sends its own sums, dims squared numbers."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = matrix(batch.column(0), dims).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i * dims + j), pa.array(total[i, j])], ["cell", "value"])

    out = np.zeros(dims * dims)
    for r in v.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    m = out.reshape(dims, dims)
    return m + np.triu(m, 1).T


def matrix(column: pa.Array, dims: int):
    """Rows of whole numbers from an Arrow list column; shorter vectors are filled up with zeros."""
    import numpy as np

    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else []] = flat
    return out


def pack(ids: pa.Array, x, norm) -> dict:
    """A block of vectors as one row; numbers of 32 bits where they fit."""
    import numpy as np

    kind = "<i4" if not len(x) or np.abs(x).max() < 1 << 31 else "<i8"
    known = ~np.asarray(ids.is_null())
    return {"n": len(x), "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(), "known": known.tobytes(), "kind": kind, "x": x.astype(kind).tobytes(), "longest": float(np.sqrt(norm.max()))}


PACKED = "n long, ids binary, known binary, kind string, x binary, longest double"


def unpack(row, dims: int) -> tuple:
    """(ids, known, vectors) of a packed row."""
    import numpy as np

    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool), np.frombuffer(row["x"], row["kind"]).reshape(-1, dims).astype(np.int64)


def packed(v: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors in the order of the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def blocks(last: bool):
            nonlocal held, count
            if not held or not (last or count >= size):
                return
            t = pa.Table.from_batches(held).combine_chunks()
            upto = count if last else count // size * size
            for i in range(0, upto, size):
                part = t.slice(i, min(size, upto - i)).to_batches()[0]
                yield pa.RecordBatch.from_pylist([pack(part.column(0), matrix(part.column(1), dims), part.column(2).to_numpy())])
            held, count = t.slice(upto).to_batches(), count - upto

        for batch in batches:
            held.append(batch)
            count += len(batch)
            yield from blocks(False)
        yield from blocks(True)

    return v.select("vec_id", "x", "norm").mapInArrow(run, PACKED)


class Best:
    """The best ``k`` candidates so far of each query of a block; a query's k-th score is its threshold."""

    def __init__(self, q, q_ids, rotation, k: int):
        import numpy as np

        self.q, self.q_ids, self.rotation, self.k = q, q_ids, rotation, k
        self.lead = max(1, int(q.shape[1] * LEADING))
        self.rq, self.length = q @ rotation, np.sqrt((q.astype(float) ** 2).sum(1))
        self.rest = np.sqrt((self.rq[:, self.lead :] ** 2).sum(1))
        self.least = np.full(len(q), -np.inf)
        self.found = [np.empty(0, np.int64)] * 5  # row, score, known, id, whether a block that was met here gave it

    def meet(self, c, c_ids, c_known) -> None:
        """Take in a block of candidates, which come by descending length.

        Bounds get a slack above rounding, and a tie with the threshold is kept, so nothing that belongs to a result is
        lost. Scores are exact: as doubles while no score can reach 2^53, else as 64-bit numbers.
        """
        import numpy as np

        rc, c_len = c @ self.rotation, np.sqrt((c.astype(float) ** 2).sum(1))
        c_rest = np.sqrt((rc[:, self.lead :] ** 2).sum(1))
        alive = np.flatnonzero(self.length * c_len.max(initial=0) * (1 + SLACK) >= self.least)
        if not len(alive) or not len(c):
            return
        upper = self.rq[alive, : self.lead] @ rc[:, : self.lead].T + np.outer(self.rest[alive], c_rest)
        upper += SLACK * (1 + np.outer(self.length[alive], c_len))
        open_ = upper >= self.least[alive][:, None]
        open_ &= ~(c_known[None, :] & (c_ids[None, :] == self.q_ids[alive][:, None]))
        columns = np.flatnonzero(open_.any(0))
        small = self.length[alive].max() * c_len.max() < 2.0**52
        kind = float if small else np.int64
        scores = (self.q[alive].astype(kind) @ c[columns].astype(kind).T).astype(np.int64)
        rows, cols = np.nonzero(open_[:, columns] & (scores >= self.least[alive][:, None]))
        self.add(alive[rows], scores[rows, cols], c_known[columns[cols]], c_ids[columns[cols]])

    def add(self, rows, scores, known, ids, new=None) -> None:
        """Merge candidates into the best: by score, then by id, null ids last."""
        import numpy as np

        new = np.ones(len(rows), np.int64) if new is None else new
        merged = [np.concatenate(x) for x in zip(self.found, (rows, scores, known.astype(np.int64), ids, new))]
        order = np.lexsort((merged[3], -merged[2], -merged[1], merged[0]))
        merged = [x[order] for x in merged]
        rows, scores = merged[:2]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        keep = place < self.k
        self.found = [x[keep] for x in merged]
        full = place == self.k - 1
        self.least[rows[full]] = scores[full]

    def frame(self) -> dict:
        """What the blocks met here gave."""
        rows, scores, known, ids, _ = (x[self.found[4] == 1] for x in self.found)
        return {"query_id": self.q_ids[rows], "known": known.astype(bool), "vec_id": ids, "score": scores}


FOUND = "query_id long, known boolean, vec_id long, score long"


def best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = found.select("query_id", F.when(F.col("known"), F.col("vec_id")).alias("vec_id"), "score")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of every query with all other rows.

    Components are floor(``scale`` * x). Queries are the rows whose id is divisible by ``every``; rows with the query's
    own id are no candidates; ties go to the smaller id, null ids last. Vectors that are null or hold null or
    non-finite components take no part; shorter vectors count as filled up with zeros. Repeated rows are candidates
    each; a query id that occurs twice is asked once for each row and returns the best of both. Empty tables and
    tables without queries give no rows. Other columns are not read. Vectors so long that a score may not fit a long raise
    a ValueError.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    v = stash(prepared(vectors, id_col, vector_col, scale), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    longest = F.coalesce(F.sqrt(F.max("norm")), F.lit(0.0)), F.coalesce(F.sqrt(F.max(F.when(is_query, F.col("norm")))), F.lit(0.0))
    n, asked_n, dims, most, most_asked = v.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0)), *longest).first()
    if not asked_n or not dims:
        return best(spark.createDataFrame([], FOUND), k)
    if most * most_asked * (1 + SLACK) >= 2.0**63:
        raise ValueError(f"scores may not fit a long: the longest vector has length {most:.6g}, the longest query {most_asked:.6g}, after scaling by {scale}")
    u, _, _ = np.linalg.svd(moments(v, dims))
    rotation = np.ascontiguousarray(u)
    size, q_size = (max(1, most_bytes // (8 * dims)) for most_bytes in (BLOCK_BYTES, QUERY_BYTES))
    parts, q_parts = -(-n // (size * CELL)), -(-asked_n // q_size)
    ordered = v.repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = packed(ordered, dims, size).withColumns({"no": F.monotonically_increasing_id(), "part": F.spark_partition_id()})
    blocks = in_groups(stash(blocks, "topk-blocks"), size * CELL)  # neighbouring partitions of few rows are one cell
    head = blocks.orderBy(F.desc("longest"), "no").first()

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, c = unpack(head, dims)
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, _, q = unpack(row, dims)
                own = Best(q, q_ids, rotation, k)
                own.meet(c, ids, known)
                found = [x.astype("<i8").tobytes() for x in own.found[:4]]
                yield pa.RecordBatch.from_pylist([row | {"lowest": float(own.least.min(initial=np.inf)), "found": found}])

    def first_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, found in zip(batch.column(0), batch.column(1).to_pylist()):
                rows, scores, known, ids = (np.frombuffer(x, "<i8") for x in found)
                yield pa.RecordBatch.from_pydict({"query_id": np.frombuffer(q_ids.as_py(), "<i8")[rows], "known": known.astype(bool), "vec_id": ids, "score": scores})

    asked = packed(v.where(is_query).repartition(q_parts), dims, q_size).mapInArrow(first_thresholds, PACKED + ", lowest double, found array<binary>")
    asked = stash(asked.withColumn("q_no", F.monotonically_increasing_id()), "topk-queries")
    # Every block of queries goes to the cells whose longest vector it can still use, and a cell's blocks to those that come.
    blocks = blocks.where(F.col("no") != head["no"])
    reach = {r["part"]: r["longest"] for r in blocks.groupBy("part").agg(F.max("longest").alias("longest")).collect()}  # one per cell

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i, (longest, lowest) in enumerate(zip(batch.column("longest").to_pylist(), batch.column("lowest").to_pylist())):
                for cell, most_there in reach.items():
                    if most_there * longest * (1 + SLACK) >= lowest:
                        yield from t.slice(i, 1).append_column("cell", pa.array([cell], pa.int32())).to_batches()

    routed = stash(asked.mapInArrow(route, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", cell int"), "topk-routed")
    wanted = routed.select(F.col("cell").alias("part"), F.col("q_no").alias("for_q")).distinct()
    met = blocks.join(wanted, "part").withColumnRenamed("part", "cell")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in q.iterrows():
            q_ids, _, own = unpack(row, dims)
            b = Best(own, q_ids, rotation, k)
            known_from = [np.frombuffer(x, "<i8") for x in row["found"]]
            b.add(*known_from, np.zeros(len(known_from[0]), np.int64))
            for _, block in c.sort_values("longest", ascending=False).iterrows():
                ids, known, x = unpack(block, dims)
                b.meet(x, ids, known)
            out.append(pd.DataFrame(b.frame()))
        return pd.concat(out, ignore_index=True)

    more = routed.groupBy("q_no", "cell").cogroup(met.groupBy("for_q", "cell")).applyInPandas(search, FOUND)
    return best(asked.select("ids", "found").mapInArrow(first_found, FOUND).unionByName(more), k)


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The ten largest inner products of every hundredth embedding with all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
