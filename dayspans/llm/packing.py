"""Best-fit packing by minimum bin slack.

Documents are tokenised and long ones cut. The histogram of piece lengths (at most as many rows as a sequence has
tokens, whatever the corpus) is all that the solver needs: it fills one bin after the other with the fullest feasible
combination of the lengths left, found by a bitset subset-sum, and uses each combination as often as the lengths last.
Pieces then find their bins by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, buckets, maybe_broadcast, running, stash

#: Token that ends every document.
END = 2
#: Texts with these go through the JSON tokenizer itself: characters on whose class regular expression engines differ.
UNSURE = r"[\x1c-\x1f\x85\u1680\u180e\u200b\u2028\u2029\u2060\ufeff]"


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None):
    """Text -> array of its ids.

    ``path`` is the JSON tokenizer. ``ranks`` may name the same vocabulary as a ranks file, whose library gives the
    same ids several times faster; a test holds both equal over whole tables. Without it the JSON tokenizer does all, and
    with it those texts that the faster library's pattern cannot get through, such as a million spaces in a row.
    """
    import base64
    import json
    import os
    import re

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # read when a text needs it
    slow = lambda text: np.array(whole().encode(text, add_special_tokens=False).ids, "<u4")
    if not ranks:
        return slow
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast, unsure = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special), re.compile(UNSURE)

    def encode(text: str):
        if not unsure.search(text):
            try:
                return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
            except ValueError:  # its regular expression ran out of stack
                pass
        return slow(text)

    return encode


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first can be shorter than ``most``."""
    first = n - (n - 1) // most * most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def tokenized(docs: DataFrame, tokenizer: str, ranks: str | None, most: int, keep_ids: bool, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length int, ids_crc32 long" + ", ids array<long>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, end = encoder(tokenizer, ranks), np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0), []
            for i, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "").tobytes() + end
                for p, (s, n) in enumerate(cut(len(data) // 4, most)):
                    own = data[4 * s : 4 * (s + n)]
                    rows.append((i, p, s, n, zlib.crc32(own), own if keep_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            out = [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())]
            if keep_ids:
                out.append(pa.array([np.frombuffer(x, "<u4").astype("i8") for x in cols[5]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, longest first, whose sum comes closest to ``room`` without exceeding it.

    Subset sums are the bits of one integer. Lengths enter longest first, so that of equal sums the one of longer
    pieces wins and short ones stay for later bins.
    """
    full, bits, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, bits))
            bits |= (bits << (length * take)) & full
            left, take = left - take, take * 2
        if bits >> room & 1:
            break
    total, out = bits.bit_length() - 1, []
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            out += [length] * take
    return sorted(out, reverse=True)


def fill(histogram: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, bins like it): bin by bin the longest piece left with the fullest combination beside it.

    A combination is used again while its lengths last, so each round uses up a length: at most as many rounds as there
    are lengths, whatever the number of pieces.
    """
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        seed = max(left)
        rest = {k: v - (k == seed) for k, v in left.items() if v > (k == seed) and k <= most - seed}
        items = [seed, *fullest(rest, most - seed)]
        need = {k: items.count(k) for k in set(items)}
        times = min(left[k] // n for k, n in need.items())
        out.append((items, times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[tuple]:
    """(length, lo, hi, per bin, first bin, offsets): pieces of a length with ranks lo .. hi - 1 go to these bins."""
    used, bins, out = {}, 0, []
    for items, times in patterns:
        at, offsets = 0, {}
        for k in items:
            offsets.setdefault(k, []).append(at)
            at += k
        for k, o in offsets.items():
            lo = used.get(k, 0)
            used[k] = lo + len(o) * times
            out.append((k, lo, used[k], len(o), bins, o))
        bins += times
    return out


def pack(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, most: int = 1024, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if they are kept.

    Texts are tokenised whole, however long, runs of a million equal characters included. A null or empty text is a document of its end token alone. Repeated rows and repeated or null ids are documents of
    their own; which of equal pieces gets which place is arbitrary. An empty table gives no pieces. Other columns are
    not read. The solver sees only the histogram of lengths, ``most`` rows at the most.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = stash(tokenized(docs, tokenizer, ranks, most, keep_ids, id_col, text_col), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    sizes = spark.createDataFrame(list(histogram.items()), "length int, n long")
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(F.broadcast(sizes), "length").withColumn("key", key).withColumn("bucket", F.expr(f"pmod(key, {buckets('n')})")).drop("n")
    ranked = running(ranked, ["length"], "bucket", ["key", "doc_id", "piece", "ids_crc32"], F.lit(1), "rank")
    table = places(fill(histogram, most))
    at = spark.createDataFrame(table, "length int, lo long, hi long, per int, bin long, offsets array<int>")
    placed = ranked.join(maybe_broadcast(at, len(table)), "length").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.expr("bin + (rank - lo) div per")).withColumn("offset", F.expr("cast(offsets[int((rank - lo) % per)] as long)"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens: where each piece goes."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)
