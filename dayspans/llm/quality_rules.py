"""Quality rules: counts of words, symbols and repetition, and compression bands.

A text that is too repetitive compresses too well, one of random characters hardly at all. The zstandard ratio of the
whole text and of each fixed chunk must lie inside limits that depend on the length, for short texts compress less. The
limits of a band of lengths come from the quartiles of the ratio over the corpus's own distinct texts of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free, stash
from .jaccard_join import mixed

#: (length in bytes up to which a band holds, least and greatest ratio of raw to compressed size): the limits where a corpus
#: has too few texts of a length to tell. They were taken from all documents of sf0.1 as ``corpus_bands`` takes them.
#: Up to 100 bytes nothing is too incompressible. Random base64 stays below 4/3 at any length.
BANDS = (
    (100, 0.0, 1.8), (200, 0.6, 2.6), (300, 1.1, 2.2), (400, 1.16, 2.3), (550, 1.3, 2.2), (750, 1.47, 2.2), (1_000, 1.52, 2.3), (1_500, 1.55, 2.7),
    (2_200, 1.79, 2.4), (3_200, 1.91, 2.4), (4_500, 1.97, 2.5), (6_500, 2.04, 2.5), (10_000, 2.07, 2.6), (1 << 62, 1.93, 3.2),
)
#: Bytes of a chunk; its band is that of its length. At most this share of a text's chunks may be out of band.
CHUNK, OUT_SHARE = 4_096, 0.2
LEVEL = 3
#: Interquartile ranges below the first and above the third quartile at which limits lie; distinct texts that a band needs for
#: limits of its own; digits of the ratios whose counts give the quartiles; the least range, as a share of the median.
BELOW, ABOVE, LEAST_TEXTS, DIGITS, LEAST_RANGE = 3.0, 2.0, 200, 3, 0.03
#: Base rules: fewest words, and the greatest percentage of words in repeated windows of so many words.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, size long, chunk_sizes array<int>, chunk_ratios array<double>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words that occurs at least twice, the first occurrence included."""
    import numpy as np

    if len(words) < WINDOW + 1:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    n = len(ids) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = mixed(h + ids[j : n + j] + np.uint64(1))
    _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(counts[which] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None, compress) -> tuple:
    """The counts of one text and its compression: ratio of the whole, size, sizes and ratios of the chunks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    word_chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in data.split(b"\n") if x.split()]
    chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
    ratio = lambda c: len(c) / len(compress(c)) if c else 0.0
    whole = ratio(data)
    ratios = [whole] if len(chunks) == 1 else [ratio(c) for c in chunks]
    return len(words), word_chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), whole, len(data), [len(c) for c in chunks], ratios


def measured(docs: DataFrame, *, text_col: str = "text", into: str = "measures") -> DataFrame:
    """Add struct column ``into``: what ``judged`` and ``corpus_bands`` need of every whole text."""

    @F.pandas_udf(COLUMNS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas as pd
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for texts in parts:
            yield pd.DataFrame([measure(t, compress) for t in texts], columns=names)

    return docs.withColumn(into, run(F.col(text_col)))


def corpus_bands(documents: DataFrame, *, measures: str = "measures", text_hash: str = "text_hash", defaults=BANDS) -> tuple:
    """Limits from a corpus with its ``measures`` and a hash of each text, by which copies count once.

    Per band the counts of the rounded ratios of all distinct texts, a few thousand rows however many texts there are, give
    the quartiles: the limits are the first less BELOW and the third plus ABOVE ranges between them. A band of fewer than
    LEAST_TEXTS texts has the default limits, and so has the lower side where the default sets none.
    """
    size, ratio = F.col(measures)["size"], F.round(F.col(measures)["ratio"], DIGITS)
    band = F.coalesce(*[F.when(size <= upto, i) for i, (upto, _, _) in enumerate(defaults)])
    distinct = documents.where(size > 0).groupBy(band.alias("band"), ratio.alias("ratio"), text_hash).agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("band", "ratio").agg(F.count("*").alias("n"))
    upto, n = F.sum("n").over(Window.partitionBy("band").orderBy("ratio")), F.sum("n").over(Window.partitionBy("band"))
    at = lambda q, name: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("ratio"))).alias(name)
    found = counts.withColumns({"upto": upto, "all": n}).groupBy("band").agg(F.first("all").alias("n"), at(0.25, "q1"), at(0.5, "q2"), at(0.75, "q3")).collect()  # a row per band
    own = {r["band"]: r for r in found if r["n"] >= LEAST_TEXTS}
    out = []
    for i, (upto_bytes, low, high) in enumerate(defaults):
        if i in own:
            r = own[i]
            width = max(r["q3"] - r["q1"], LEAST_RANGE * r["q2"])
            low, high = (r["q1"] - BELOW * width if low else 0.0), r["q3"] + ABOVE * width
        out.append((upto_bytes, low, high))
    return tuple(out)


def judged(documents: DataFrame, bands=BANDS, *, measures: str = "measures", into: str = "rules") -> DataFrame:
    """Add struct column ``into``, from the measures: counts, ratio, share of chunks out of their band, base_failed, kept."""
    x = F.col(measures)

    def inside(size: Column, ratio: Column) -> Column:
        fits = F.lit(False)
        for upto, low, high in reversed(bands):
            fits = F.when(size <= upto, ratio.between(low, high)).otherwise(fits)
        return fits

    failed = (x["n_words"] < MIN_WORDS) | (x["n_repeat_words"] * 100 > x["n_words"] * REPEAT_PERCENT)
    fine = F.zip_with(x["chunk_sizes"], x["chunk_ratios"], inside)
    chunks_out = F.when(F.size(fine) > 0, F.size(F.filter(fine, lambda f: ~f)) / F.size(fine)).otherwise(0.0)
    fields = [x[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio")]
    kept = ~failed & inside(x["size"], x["ratio"]) & (chunks_out <= OUT_SHARE)
    return documents.withColumn(into, F.struct(*fields, chunks_out.alias("chunks_out"), failed.alias("base_failed"), kept.alias("kept")))


def assess(docs: DataFrame, *, text_col: str = "text", into: str = "rules", bands=BANDS) -> DataFrame:
    """Add struct column ``into``: counts, compression, base_failed, kept, by given ``bands``; ``corpus_bands`` makes a corpus's own.

    A null text counts as empty: it has no words and fails the base rules. Rows, repeats and other columns pass
    through; a column of the name ``into`` is replaced; an empty table gives an empty one. Every count is over the whole
    text, however long; a long one is judged by its whole ratio and by all of its chunks.
    """
    name = free(docs, "measures")
    return judged(measured(docs, text_col=text_col, into=name), bands, measures=name, into=into).drop(name)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document, by limits from all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    documents = stash(measured(docs).drop("text"), "quality-measures")
    done = judged(documents, corpus_bands(documents))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_out")
    return done.select("doc_id", *[F.col(f"rules.{c}").alias(c) for c in fields])


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The part of ``op6_quality_rules`` that SQL can express: the counts and the base rules."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + {WINDOW - 1}] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM t)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(0, {WINDOW})) AS p FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM t LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m
"""
