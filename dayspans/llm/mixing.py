"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a cyclic stream of its documents in shuffled order, cut into blocks of equal word counts. The mix is a
sequence of slots; slot ``i`` has the van der Corput point of ``i``, which falls into one source's interval of the
cumulative block quotas, and the n-th slot of a source takes the source's n-th block. The rank of a slot within its
source has a closed form for these points, so no source is ever gathered or sorted in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import buckets, maybe_broadcast, n_words, packed_row, running, stash

#: Bits of the schedule's points; a mix has fewer slots than 2 to this power.
BITS = 40
#: Leading bits by which slots find their source's interval.
CELL_BITS = 12


class Mix(NamedTuple):
    """``documents``: a row per input row; ``schedule``: a row per slot and document piece; ``sources``: a row per source."""

    documents: DataFrame
    schedule: DataFrame
    sources: DataFrame


def point(i: str) -> str:
    """SQL: the van der Corput point of ``i`` in base 2, times 2 to the power BITS."""
    return "(" + " + ".join(f"shiftleft(shiftright({i}, {k}) & 1L, {BITS - 1 - k})" for k in range(BITS)) + ")"


def points_below(i: str, u: str, x: str) -> str:
    """SQL: how many of the points of 0 .. i-1 are below ``x``; ``u`` is the point of ``i``.

    Each 1-bit k of i stands for a run of 2^k numbers whose points are an even grid with a known offset.
    """
    terms = [f"(shiftright({i}, {k}) & 1L) * shiftright({x} - ({u} & {(1 << (BITS - k - 1)) - 1}L) + {(1 << (BITS - k)) - 1}L, {BITS - k})" for k in range(BITS)]
    return "(" + " + ".join(terms) + ")"


def order_key(seed: int, doc_id: str, size: str) -> Column:
    """60 bits of a checksum of seed, id and size: the shuffled order of a source's documents."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"), F.col(size).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row per source: idx, source, n_docs, source_size, target.

    Sources by code point, null last, take the weights in turn. Together they get ``share`` times all sizes, but each
    at most ``cap`` times its own; what is over goes to the others by weight (water filling).
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", "idx")
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("idx", F.row_number().over(every) - 1)
    s = s.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("idx") % len(weights)])
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("most") / F.col("weight"))
    capped = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("water", (F.sum("source_size").over(whole) * F.lit(float(share)) - capped) / rest)
    s = s.withColumn("water", F.max(F.when(F.col("water") <= F.col("level"), F.col("water"))).over(whole))
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("water")))
    return s.select("idx", "source", "n_docs", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 1024, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Mix the documents of all sources to target weights.

    Sizes are words (null text: 0; such rows take no part and have taken 0). A null source is a source of its own, last
    in order. Repeated rows and repeated or null ids each count as rows of their own. An empty table gives empty
    frames. Other columns are not read, so their names cannot clash. Reruns agree: the shuffled order depends on id,
    size and seed alone, and only equal rows can change places.
    """
    spark = docs.sparkSession
    size = n_words(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    sized = sized.select("*", order_key(seed, "doc_id", "size").alias("key"), F.monotonically_increasing_id().alias("row"))
    sized = stash(sized, "mix-sizes")
    sources = stash(targets(sized, weights, share, cap).withColumn("take", F.round("target").cast("long")).withColumn("quota", F.expr(f"(take + {block_words - 1}) div {block_words}")), "mix-sources")
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()

    # Intervals of the sources on the points' scale, and the cells that they touch.
    upto = Window.orderBy("idx")
    scale = F.lit(float(1 << BITS))
    ends = F.sum("quota").over(upto)
    frame = sources.where("quota > 0").withColumn("hi", F.floor(ends / F.lit(float(max(slots, 1))) * scale)).withColumn("lo", F.floor((ends - F.col("quota")) / F.lit(float(max(slots, 1))) * scale))
    cells = frame.where("hi > lo").select("idx", "quota", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {BITS - CELL_BITS}), shiftright(hi - 1, {BITS - CELL_BITS}))")).alias("cell"))
    n = spark.range(0, slots, 1, max(spark.sparkContext.defaultParallelism, slots // 1_000_000)).withColumn("u", F.expr(point("id")))
    n = n.withColumn("cell", F.shiftright("u", BITS - CELL_BITS))
    drawn = n.join(maybe_broadcast(cells, (1 << CELL_BITS) + n_sources), "cell").where("u >= lo and u < hi")
    drawn = drawn.withColumn("rank", F.expr(f"{points_below('id', 'u', 'hi')} - {points_below('id', 'u', 'lo')}")).where("rank < quota")
    drawn = drawn.select(F.col("id").alias("slot"), "idx", "rank")
    # A source's slots differ from its quota by a few at most; what is missing follows at the end.
    whole = frame.withColumn("all", F.lit(slots).cast("long")).withColumn("u", F.expr(point("all")))
    whole = whole.withColumn("given", F.expr(f"{points_below('all', 'u', 'hi')} - {points_below('all', 'u', 'lo')}")).where("given < quota")
    tail = whole.select("all", "idx", "given", F.explode(F.expr("sequence(given, quota - 1)")).alias("rank")).select(F.expr("all + rank - given").alias("slot"), "idx", "rank")
    schedule = drawn.union(tail)

    # Positions of the documents in their source's stream.
    own = maybe_broadcast(sources, n_sources)
    placed = sized.where("size > 0").alias("d").join(own.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    placed = placed.select("row", "doc_id", "size", "key", "idx", "take", "source_size", F.expr(f"pmod(key, {buckets('n_docs')})").alias("bucket"))
    placed = running(placed, ["idx"], "bucket", ["key", "doc_id", "size", "row"], F.col("size"), "at")
    laps = placed.where("take > 0").withColumn("lap", F.explode(F.expr("sequence(0L, (take - 1) div source_size)"))).withColumn("from", F.expr("at + lap * source_size")).where("from < take").withColumn("to", F.expr("least(from + size, take)"))
    pieces = laps.withColumn("rank", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")))
    start, end = F.expr(f"greatest(from, rank * {block_words})"), F.expr(f"least(to, (rank + 1) * {block_words})")
    pieces = pieces.select("row", "doc_id", "idx", "rank", "lap", (start - F.col("from")).alias("start_word"), (end - start).alias("words"))
    schedule = schedule.join(pieces, ["idx", "rank"]).select("slot", "idx", "rank", "row", "doc_id", "lap", "start_word", "words")

    taken = schedule.groupBy("row").agg(F.sum("words").alias("taken"), F.countDistinct("lap").alias("copies"))
    out = sized.alias("d").join(own.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("row", "doc_id", "size", "d.source", "source_size", "target")
    out = out.join(taken, "row", "left").withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("long"), "copies": F.coalesce("copies", F.lit(0)).cast("long")})
    return Mix(out, schedule, sources)


def mixed_documents(docs: DataFrame, *, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, in whole copies; columns as in ``docs``.

    A source's last document, of which the mix takes a part, comes whole; if it is one of several equal rows, all of
    them come. Documents without words are in no mix.
    """
    m = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    # The mix takes a source's stream from its start: some whole laps, then all up to one document. So a row per source
    # tells each document its copies, and no text is shuffled. Documents travel as one column: no name of theirs can clash.
    place = F.struct(F.expr(f"pmod(key, {buckets('n_docs')})").alias("bucket"), "key", "doc_id", "size")
    laps = m.sources.select("source", "n_docs", F.expr("coalesce(try_divide(take - take % source_size, source_size), 0)").cast("int").alias("laps"))
    d = m.documents.where("copies > 0").withColumn("key", order_key(seed, "doc_id", "size")).alias("d").join(laps.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")))
    last = d.where("copies > laps").select("d.source", place.alias("at")).groupBy("source").agg(F.max("at").alias("last"))
    per = laps.alias("l").join(last.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")), "left").select("l.source", "n_docs", "laps", "last")
    per = stash(per, "mix-copies")
    out = docs.select(packed_row(docs).alias("own"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")).where("size > 0")
    out = out.withColumn("key", order_key(seed, "doc_id", "size")).alias("d").join(maybe_broadcast(per, per.count()).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = F.col("laps") + F.coalesce(place <= F.col("last"), F.lit(False)).cast("int")
    return out.select("own", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select("own.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 3, 1, 2: what the mix takes of each."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: A source's stream in the order of the buckets; what the mix takes of it is its start, after some whole laps.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM s),
w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM i),
v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY most / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM w),
x AS (SELECT *, max(CASE WHEN water <= most / weight THEN water END) OVER () AS level FROM v),
t AS (SELECT source, n_docs, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, weight * level) END AS target FROM x),
k AS (SELECT d.doc_id, d.size, t.*, CAST('0x' || md5(concat_ws(':', '42', d.doc_id, d.size))[1:15] AS BIGINT) AS key, CAST(round(target) AS BIGINT) AS take FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key % CAST(ceil(n_docs / greatest(256.0::DOUBLE, sqrt(n_docs))) AS BIGINT), key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(take // source_size * size + greatest(least(take % source_size - pos, size), 0) AS BIGINT) END AS taken FROM p
"""
