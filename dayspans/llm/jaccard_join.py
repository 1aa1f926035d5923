"""Similarity join of word n-gram sets under the Jaccard measure, as components of linked documents.

1. Equal texts form one class. Every class's n-grams are hashed; packed inverted lists meet by hash range, which gives
   each n-gram its document frequency, and the lists of two or more go back to their documents.
2. A document whose n-grams are shared too rarely for any partner is done. The others order their shared n-grams rarest
   first; a partner must share one of the first few (prefix).
3. T-occurrence search with DivideSkip decides every pair. First it asks for each inverted list's fullest member among
   the list's others, which joins large groups of near copies with as many pairs as members.
4. Lists whose members are still in several components are searched as a whole, in blocks of bounded size. Members are dealt to blocks by their smallest list, and only blocks with a list in common meet,
   leaving out pairs of one component.

``link_counts`` leaves out step 3 and the components and counts every link by the search alone.

N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free, join_hot, maybe_broadcast, stash
from .components import components

#: N-grams of one packed chunk of documents, and of one range of hashes, about.
CHUNK, RANGE = 1_000_000, 1_000_000
#: A chunk's n-gram that so many of its documents have travels as a count; its list stays with the chunk.
HEAVY = 8
#: Members of one block in the exact search.
BLOCK = 512
#: DivideSkip's weight: the larger, the fewer long lists are left to binary probes.
MU = 0.001

PACKED = "part long, chunk long, a binary, b binary, c binary"


def hashes(text: str | None, width: int):
    """Sorted distinct 64-bit hashes of the word n-grams of a text; a text of fewer words is one n-gram.

    Words are lower-cased in A-Z and split at ASCII white space. A word's hash is a polynomial of its bytes, taken from
    running sums over the whole text, so that nothing is done word by word.
    """
    import numpy as np

    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not inner.any():
        return np.empty(0, np.uint64)
    edges = np.diff(np.concatenate(([0], inner.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.cumprod(np.full(len(data), base))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)))
    back = np.cumprod(np.full(len(data), inverse))
    words = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        out = mixed(out ^ words[j : len(words) - k + 1 + j])
    return np.unique(out)


def mixed(x):
    """Spread the bits of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def planes(values) -> bytes:
    """Numbers byte plane by byte plane, which the shuffle's compression shrinks where high bytes are alike."""
    import numpy as np

    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplanes(data: bytes, kind):
    import numpy as np

    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def packer(width: int, parts: int):
    """Arrow batches of (k, text) -> packed inverted lists by range of hashes, and a row with each chunk's documents."""

    def flush(task: int, n: int, keys: list, sets: list, starts) -> Iterator[tuple]:
        import numpy as np

        chunk, sizes = (task << 20) + n, np.array([len(s) for s in sets], np.uint32)
        all_, docs = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(all_, kind="stable")
        all_, docs = all_[order], docs[order]
        first = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1]))) if len(all_) else np.empty(0, int)
        runs = np.diff(np.append(first, len(all_)))
        heavy = np.repeat(runs >= HEAVY, runs)
        yield -1 - chunk, chunk, b"".join(keys), sizes.tobytes(), all_[heavy].tobytes() + docs[heavy].tobytes()
        one = first[runs >= HEAVY]
        light = ~heavy
        light[one] = True
        docs[one] = runs[runs >= HEAVY].astype(np.uint32) | np.uint32(1 << 31)
        all_, docs = all_[light], docs[light]
        where = np.searchsorted(starts, all_, "right") - 1
        cuts = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(all_))  # only the ranges that have any
        for a, b in zip(cuts, cuts[1:]):
            yield int(where[a]), chunk, planes(np.diff(all_[a:b], prepend=np.uint64(0))), planes(docs[a:b]), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        task, n, keys, sets, held = TaskContext.get().partitionId(), 0, [], [], 0
        starts = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
        names = ["part", "chunk", "a", "b", "c"]

        def out():
            rows = list(flush(task, n, keys, sets, starts))
            for i in range(0, len(rows), 256):
                cols = list(zip(*rows[i : i + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 2 + [pa.binary()] * 3)], names)

        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                sets.append(hashes(text.as_py(), width))
                held += len(sets[-1])
                if held >= CHUNK:
                    yield from out()
                    n, keys, sets, held = n + 1, [], [], 0
        if keys:
            yield from out()

    return run


def meet(group: pd.DataFrame) -> pd.DataFrame:
    """One range of hashes: the document frequency of every n-gram, sent back to the chunks that have it if it is shared."""
    import numpy as np

    names = ["chunk", "a", "b", "c"]
    if group["part"].iloc[0] < 0:
        return group[names]
    hs = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in group["a"]]
    docs = np.concatenate([unplanes(x, np.uint32) for x in group["b"]])
    chunk = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
    all_ = np.concatenate(hs)
    order = np.argsort(all_, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], all_[order][1:] != all_[order][:-1])))
    weight = np.where(docs >> 31, docs & 0x7FFFFFFF, 1).astype(np.int64)
    df = np.empty(len(all_), np.int64)
    df[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(all_))))
    shared = df > 1
    rows = []
    for i in np.unique(chunk[shared]):
        m = shared & (chunk == i) if len(hs) < 64 else np.flatnonzero(shared[np.searchsorted(chunk, i) : np.searchsorted(chunk, i + 1)]) + np.searchsorted(chunk, i)
        own = all_[m]
        rows.append((group["chunk"].iloc[i], planes(np.diff(own, prepend=np.uint64(0))), planes(docs[m]), planes(np.minimum(df[m], 0xFFFFFFFF).astype(np.uint32))))
    return pd.DataFrame(rows, columns=names)


def regroup(percent: int):
    """One chunk: per document its size and, if enough of its n-grams are shared, those n-grams, rarest first."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        is_docs = group["heavy"].to_numpy()
        book = group[is_docs].iloc[0]
        rows = group[~is_docs]
        sizes = np.frombuffer(book["b"], np.uint32)
        keys = [book["a"][16 * i : 16 * i + 16] for i in range(len(sizes))]
        heavy_n = len(book["c"]) // 12
        heavy_h, heavy_d = np.frombuffer(book["c"][: 8 * heavy_n], np.uint64), np.frombuffer(book["c"][8 * heavy_n :], np.uint32)
        cat = lambda xs, kind: np.concatenate([np.empty(0, kind), *xs])
        h = cat([np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in rows["a"]], np.uint64)
        d = cat([unplanes(x, np.uint32) for x in rows["b"]], np.uint32)
        f = cat([unplanes(x, np.uint32) for x in rows["c"]], np.uint32)
        counted = (d >> np.uint32(31)).astype(bool)
        known = np.argsort(h[counted])
        heavy_f = f[counted][known][np.searchsorted(h[counted][known], heavy_h)] if heavy_n else np.empty(0, np.uint32)
        h, d, f = np.concatenate([h[~counted], heavy_h]), np.concatenate([d[~counted], heavy_d]), np.concatenate([f[~counted], heavy_f])
        order = np.lexsort((h, f, d))
        h, d = h[order], d[order]
        ends = np.searchsorted(d, np.arange(len(sizes) + 1))
        need = -(-percent * sizes.astype(np.int64) // 100)
        have = np.diff(ends)
        shared = [h[ends[i] : ends[i + 1]].view(np.int64) if sizes[i] and have[i] >= need[i] else None for i in range(len(sizes))]
        return pd.DataFrame({"k": keys, "n": sizes.astype(np.int32), "shared": shared})

    return run


def occurrence_search(percent: int, every: bool = False, hubs: bool = False):
    """Links between the two blocks of a pair, or within one: DivideSkip over the blocks' inverted lists.

    Only one link is kept between two components, and components merge as links are found; pairs within one are skipped.
    With ``every`` nothing is skipped, and the links are counted: (a, links), each link with the other's ``weight``.
    With ``hubs`` the second side asks and the first one answers, even if it holds no other.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values(["side", "k"]).reset_index(drop=True)
        n, side = group["n"].to_numpy(np.int64), group["side"].to_numpy()
        sets = [np.sort(np.asarray(s)) for s in group["shared"]]
        c = np.array([len(s) for s in sets])
        comp = np.arange(len(sets)) if every else np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        weight = group["weight"].to_numpy(np.int64) if every else None
        alone = not hubs and (side == side[0]).all()
        all_, docs = np.concatenate(sets), np.repeat(np.arange(len(sets)), c)
        order = np.argsort(all_, kind="stable")
        all_, docs = all_[order], docs[order]
        found, links = [], np.zeros(len(sets), np.int64)
        for x in range(len(sets)):
            others = np.flatnonzero(comp != comp[x])
            fits = np.zeros(len(sets), bool)
            fits[others] = np.minimum(c[others], c[x]) * (100 + percent) >= percent * (n[others] + n[x])
            fits &= np.arange(len(sets)) < x if alone else side < side[x]
            if not fits.any():
                continue
            lo, hi = np.searchsorted(all_, sets[x]), np.searchsorted(all_, sets[x], "right")
            lists = sorted((own for own in (docs[a:b][fits[docs[a:b]]] for a, b in zip(lo, hi)) if len(own)), key=len)
            need = -(-percent * (n[x] + n[fits].min()) // (100 + percent))
            if len(lists) < need:
                continue
            # The longest lists are left to binary probes; never all that are needed, so that a partner shows in a short one.
            n_long = min(need - 1, max(int(need / (MU * np.log2(1 + len(lists[-1])) + 1)), len(lists) - 64))
            short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
            seen = [(y, sum(1 for _ in g)) for y, g in groupby(merge(*(s.tolist() for s in short)))]
            ys, counts = (np.array(v, np.int64) for v in zip(*seen)) if seen else (np.empty(0, np.int64),) * 2
            ys, counts = ys[counts >= need - n_long], counts[counts >= need - n_long]
            for own in long_:
                if len(ys):
                    counts = counts + (own[np.minimum(np.searchsorted(own, ys), len(own) - 1)] == ys)
            hits = ys[counts * (100 + percent) >= percent * (n[ys] + n[x])]
            if every:
                links[x] += weight[hits].sum()
                links[hits] += weight[x]
                continue
            for y in hits:
                if comp[y] != comp[x]:
                    found.append((group["k"][x], group["k"][y]))
                    comp[comp == comp[y]] = comp[x]
        if every:
            return pd.DataFrame({"a": group["k"], "links": links})[links > 0]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def searched(lists: DataFrame, s: DataFrame, search, schema: str) -> DataFrame:
    """The occurrence search over inverted lists (h, k, comp), in blocks that have a list in common.

    Lists that share a component are one cluster, mostly a small one, which is one block. In larger ones a component with
    more than BLOCK members gets blocks of its own, which never meet each other; the others are dealt by their smallest
    list, so that members of one list lie in few blocks, and a list with very many is dealt on by key.
    """
    low = stash(lists.groupBy("h").agg(F.min("comp").alias("low"), F.count("*").alias("n_rows")), "join-low")
    bridge = join_hot(lists, low, "h", lists.count()).select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct()
    clusters = stash(components(bridge), "join-clusters").select(F.col("node").alias("comp"), F.col("root").alias("cluster"))
    m = stash(lists.groupBy("k").agg(F.min("h").alias("least"), F.first("comp").alias("comp")).join(clusters, "comp"), "join-least")
    per_comp = m.groupBy("cluster", "comp").agg(F.count("*").alias("in_comp"))
    large = stash(per_comp.groupBy("cluster").agg(F.sum("in_comp").alias("in_cluster")).where(F.col("in_cluster") > BLOCK), "join-large")
    pure = stash(per_comp.where(F.col("in_comp") > BLOCK).select("comp", "in_comp"), "join-pure")
    m = m.join(maybe_broadcast(large, large.count()), "cluster", "left").join(maybe_broadcast(pure, pure.count()), "comp", "left")
    cell = F.expr(f"case when in_comp is null then pmod(xxhash64(least), coalesce((in_cluster + {BLOCK - 1}) div {BLOCK}, 1)) else -1 end")
    m = stash(m.withColumns({"pure": F.when(F.col("in_comp").isNotNull(), F.hex("comp")).otherwise(""), "cell": cell}), "join-cells")
    per = stash(m.groupBy("cluster", "pure", "cell").agg(F.count("*").alias("in_cell")).where(F.col("in_cell") > BLOCK), "join-full")
    m = m.join(maybe_broadcast(per, per.count()), ["cluster", "pure", "cell"], "left")
    no = F.expr(f"pmod(xxhash64(k), coalesce((in_cell + {BLOCK - 1}) div {BLOCK}, 1))")
    block = F.struct("cluster", F.col("pure").alias("p"), "cell", no.alias("no"))
    m = stash(m.select("k", "comp", block.alias("block")), "join-members")
    at = stash(lists.select("h", "k").join(m.select("k", "block"), "k").select("h", "block").distinct(), "join-at")
    todo = at.join(at.select("h", F.col("block").alias("block2")), "h").where("block <= block2 and not (block.p <> '' and block.p = block2.p)").select("block", "block2").distinct()
    todo = stash(todo, "join-todo")
    first = todo.select("block", "block2", F.lit(1).alias("side"), F.col("block").alias("own"))
    second = todo.where("block <> block2").select("block", "block2", F.lit(2).alias("side"), F.col("block2").alias("own"))
    asked = first.union(second).join(m.withColumnRenamed("block", "own"), "own").drop("own").join(s, "k")
    return asked.groupBy("block", "block2").applyInPandas(search, schema)


def shared_ngrams(texts: DataFrame, chars: int, width: int, percent: int) -> DataFrame:
    """Per class: k, n (n-grams), shared (its shared n-grams, rarest first; null where too few for any partner)."""
    parts = max(1, -(-chars // (5 * RANGE)))
    lists = texts.mapInArrow(packer(width, parts), PACKED)
    back = lists.groupBy("part").applyInPandas(meet_tagged, "chunk long, heavy boolean, a binary, b binary, c binary")
    found = back.groupBy("chunk").applyInPandas(regroup(percent), "k binary, n int, shared array<long>")
    return found.groupBy("k").agg(F.first("n").alias("n"), F.first("shared", ignorenulls=True).alias("shared"))


def meet_tagged(group: pd.DataFrame) -> pd.DataFrame:
    return meet(group).assign(heavy=group["part"].iloc[0] < 0)[["chunk", "heavy", "a", "b", "c"]]


def prefixes(near: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes that can have a partner (k, n, shared, c shared n-grams), and their prefixes (k, n, c, h)."""
    s = near.where("shared is not null").withColumn("c", F.size("shared"))
    need = F.expr(f"cast(ceil({percent} * n / 100) as int)")
    return s, stash(s.select("k", "n", "c", F.explode(F.slice("shared", F.lit(1), F.col("c") - need + 1)).alias("h")), "join-prefix")


def linked(near: DataFrame, percent: int) -> DataFrame:
    """(k, root): component of every class with a link; k is a class's key, root the smallest key of its component."""
    s, prefix = prefixes(near, percent)
    can = lambda a, b: F.least(f"{a}c", f"{b}c") * (100 + percent) >= (F.col(f"{a}n") + F.col(f"{b}n")) * percent
    full = F.max_by(F.struct("k", "n", "c"), F.struct(F.col("c") / F.col("n"), "k"))
    lists = prefix.groupBy("h").agg(F.count("*").alias("n_rows"), full.alias("p")).where("n_rows > 1").select("h", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("p.c").alias("pc"), "n_rows")
    lists, total = stash(lists, "join-lists"), prefix.count()
    pairs = join_hot(prefix, lists, "h", total).where(can("", "p") & (F.col("k") != F.col("pk")))
    pairs = pairs.groupBy(F.least("k", "pk").alias("a"), F.greatest("k", "pk").alias("b")).agg(F.min("pk").alias("hub"))
    pairs = stash(pairs.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("k")), "join-hubs")
    stars = stash(asked_hubs(pairs, s.select("k", "n", "shared"), percent), "join-stars")
    roots = stash(components(stars), "join-roots")

    # Lists that still have members of several components.
    at = prefix.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").select("h", "k", F.coalesce("root", "k").alias("comp"))
    at = stash(at, "join-comps")
    split = at.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n_rows")).where("low <> high").select("h", "n_rows")
    open_ = stash(join_hot(at, stash(split, "join-split"), "h", total), "join-open")
    plain = roots.select(F.col("node").alias("k"), "root")
    if open_.isEmpty():
        return plain
    more = stash(searched(open_, s.select("k", "n", "shared"), occurrence_search(percent), "a binary, b binary"), "join-more")
    if more.isEmpty():
        return plain
    every = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)
    return components(every).select(F.col("node").alias("k"), "root")


def asked_hubs(pairs: DataFrame, s: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of pairs (hub, k): some hubs at a time are the queries, their partners the lists, BLOCK partners in one task at most."""
    groups = max(1, -(-pairs.count() // BLOCK))
    p = pairs.withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(groups)))
    sizes = p.groupBy("bucket").agg(F.count("*").alias("in_bucket"))
    p = p.join(maybe_broadcast(sizes, groups), "bucket").withColumn("part", F.expr(f"pmod(xxhash64(k), (in_bucket + {BLOCK - 1}) div {BLOCK})"))
    sides = p.select("bucket", "part", "k", F.lit(1).alias("side")).union(p.select("bucket", "part", F.col("hub"), F.lit(2))).distinct()
    return sides.withColumn("comp", F.col("k")).join(s, "k").groupBy("bucket", "part").applyInPandas(occurrence_search(percent, hubs=True), "a binary, b binary")


def classes_of(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, k, chars), classes of equal texts (k, rep, chars, n_rows), and the classes' shared n-grams."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.md5(text.cast("binary")))
    rows = stash(docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.octet_length(text).cast("long").alias("chars")), "join-rows")
    classes = stash(rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("chars").alias("chars"), F.count("*").alias("n_rows")), "join-classes")
    chars, total = classes.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    several = classes.where("n_rows > 1").select("k", "rep", "n_rows")
    skip = stash(join_hot(rows.select("doc_id", "k"), several, "k", total).where("doc_id <> rep").select("doc_id", "k").distinct(), "join-skip")
    texts = docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.col(text_col).alias("text"))
    texts = texts.join(maybe_broadcast(skip, skip.count()), ["doc_id", "k"], "left_anti").select("k", "text")
    return rows, classes, stash(shared_ngrams(texts, chars, width, percent), "join-near")


def grouped(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, k (key of its text), n_shingles, root (key of its component), component_id; see ``similarity_join``."""
    rows, classes, near = classes_of(docs, width, percent, id_col, text_col)
    roots = linked(near, percent)
    info = near.select("k", "n").join(classes.select("k", "rep", "n_rows"), "k").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    info = stash(info, "join-info")
    least = stash(info.where("n > 0").groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("n_rows")).where("n_rows > 1"), "join-least")
    named = join_hot(info.withColumnRenamed("n_rows", "copies"), least, "root", info.count(), "left")
    named = stash(named.select("k", "n", "root", F.when(F.col("n") > 0, F.coalesce("least", "rep")).alias("component_id"), F.col("copies").alias("n_rows")), "join-named")
    out = join_hot(rows, named, "k", rows.count(), "left")
    return out.select("doc_id", "k", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def link_counts(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_links, how many other rows it links with; copies of its own text count, none is expanded.

    Rows, nulls and texts without words as in ``similarity_join``. Every pair of different texts that share a prefix list
    is counted by the search itself, so the work of a group of near copies grows with the square of its different texts.
    """
    rows, classes, near = classes_of(docs, width, percent, id_col, text_col)
    s, prefix = prefixes(near, percent)
    lists = stash(prefix.groupBy("h").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "join-lists")
    at = stash(join_hot(prefix, lists, "h", prefix.count()).select("h", "k", F.col("k").alias("comp")), "join-open")
    weighed = s.select("k", "n", "shared").join(classes.select("k", F.col("n_rows").alias("weight")), "k")
    found = searched(at, weighed, occurrence_search(percent, every=True), "a binary, links long").groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    per = classes.select("k", "n_rows").join(near.select("k", "n"), "k").join(found, "k", "left")
    per = stash(per.select("k", F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("n_rows") - 1).otherwise(0).alias("n_links"), "n_rows"), "join-links")
    return join_hot(rows, per, "k", rows.count(), "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similarity_join(docs: DataFrame, **options) -> DataFrame:
    """Per input row: doc_id, n_shingles, component_id, the smallest id reachable by links.

    Two rows link when their sets of word n-grams overlap in ``percent`` of their union or more; with fewer words than
    ``width`` the whole sequence is the one n-gram. Null, empty and wordless texts have no n-grams and link with
    nothing, not even with each other: their component is their own id. Equal texts are one class and are compared
    once. Null ids take part but never name a component, unless all of it have none. An empty table gives no rows.
    Other columns are not read.
    """
    return grouped(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, wordless ones all do.

    Columns as in ``docs``. Of repeated rows of that id one stays. A row without an id stays only if all of its component have none.
    """
    found = stash(grouped(docs, id_col=id_col, text_col=text_col, **options).where("n_shingles > 0").select("doc_id", "k", "root"), "groups")
    own = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k")
    first = stash(found.groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"), "groups-first")
    judged = join_hot(found, first, "root", found.count()).withColumn("is_first", own.eqNullSafe(F.col("first")))
    leave = stash(judged.where("not is_first").select("doc_id", "k").distinct(), "groups-leave")
    again = stash(judged.where("is_first").groupBy("doc_id", "k").count().where("count > 1").select("doc_id", "k"), "groups-again")
    k = free(docs, "text_key")
    d = docs.withColumn(k, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    same = lambda other: d[id_col].eqNullSafe(other["doc_id"]) & (d[k] == other["k"])
    kept = d.join(maybe_broadcast(leave, leave.count()), same(leave), "left_anti")
    if not again.isEmpty():  # repeated rows
        d = kept
        kept = d.join(again, same(again), "left_anti").unionByName(d.join(again, same(again), "left_semi").dropDuplicates([id_col, k]))
    return kept.select(*docs.columns)


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word n-grams have a Jaccard similarity of 0.85 or more."""
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of documents with a common shingle; components by the smallest id that is reached.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
