"""Toxicity by compression distance.

Texts are written as fixed-width codes: every word as four 64-bit hashes, of its first four, five and six bytes and of
the whole, so that a known insult, or a known stem with a new ending, is worth the same number of bytes in any language.
zstandard trains one dictionary on all codes of toxic texts and one on all codes of ordinary texts. Every window of a
text is compressed with the ordinary dictionary alone and with the toxic one beside it: the difference of the two lengths
is what toxic texts know of the window that ordinary ones do not. The windows' differences above a calibrated threshold,
per window of the text, are held against a second threshold. Both come from labelled texts that train no dictionary, and
so does the choice among a few sizes of the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, sampled

#: Labelled rows of each class that are used for training, about.
TRAIN_TOXIC, TRAIN_ORDINARY = 4_000, 8_000
#: One in so many training rows calibrates the thresholds and trains no dictionary.
CALIBRATE = 3
#: Folds by checksum of the id; fold 0 is held out.
FOLDS = 5
#: Words of one window; prefixes that have a code of their own.
WINDOW, PREFIXES = 16, (4, 5, 6)
#: Bytes of the toxic and of the ordinary dictionary that are tried. The ordinary one is larger: it must know what it may.
SIZES = ((12_000, 96_000), (16_000, 64_000), (40_000, 400_000))
#: Bytes of the codes, or of the calibrating texts, that are held of each class; texts beyond that train nothing.
HELD_BYTES = 1 << 24
#: Share of ordinary windows whose differences the windows' threshold leaves out; windows that every text has on top of its
#: own when differences are taken per window, so that a short text needs more than one odd word.
QUIET, MORE = 0.95, 6
#: How much a false alarm among ordinary texts weighs against a toxic text that is missed, both as shares of their class.
ALARM = 3.0
#: A level that looks a match up at every byte; faster ones skip ahead where nothing matched.
LEVEL = 6


class Model(NamedTuple):
    """Dictionaries, the windows' threshold, and the texts' threshold."""

    toxic: bytes
    ordinary: bytes
    quiet: float
    least: float


def codes(text: str | None):
    """A row of codes for each word of a text: its prefixes' and its own; a word shorter than a prefix repeats its own.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case.
    """
    import numpy as np

    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inner = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    if not inner.any():
        return np.empty((0, len(PREFIXES) + 1), np.uint64)
    edges = np.diff(np.concatenate(([0], inner.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(len(data), base)))))
    back = np.cumprod(np.full(len(data), inverse))[starts]
    out = []
    for p in (*PREFIXES, None):
        stops = ends if p is None else np.minimum(starts + p, ends)
        x = (sums[stops] - sums[starts]) * back + (stops == ends).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(29)))
    return np.stack(out, axis=1)


def trained(sets: list, size: int) -> bytes:
    """A zstandard dictionary trained on texts' code sets; too few to train on stand as they are."""
    import numpy as np
    import zstandard

    samples = [t.astype("<u8").tobytes() for t in sets if len(t)]
    try:
        return zstandard.train_dictionary(size, samples, k=8, d=8).as_bytes()
    except zstandard.ZstdError:
        return np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))[: size // 8].astype("<u8").tobytes()


def comparer(toxic: bytes, ordinary: bytes):
    """Text -> per window, the bytes by which the toxic dictionary beside the ordinary one makes it shorter than that alone."""
    import numpy as np
    import zstandard

    make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    a, b = make(toxic + ordinary), make(ordinary)

    def differences(text: str | None):
        rows = codes(text)
        data, step = rows.astype("<u8").tobytes(), WINDOW * rows.shape[1] * 8
        return np.array([len(b.compress(data[i : i + step])) - len(a.compress(data[i : i + step])) for i in range(0, len(data), step)] or [0], float)

    return differences


def distance(differences, quiet: float) -> float:
    """What the differences have above the windows' threshold, per window."""
    import numpy as np

    return float(np.maximum(differences - quiet, 0).sum()) / (MORE + len(differences))


def calibrate(differences: list, y: list[int]) -> tuple[float, float, float]:
    """(windows' threshold, texts' threshold, worth) from labelled texts.

    Windows: what QUIET of the ordinary texts' windows stay at or below. Texts: the middle of the range of thresholds with
    the best worth, the share of toxic texts that reach it less ALARM times that of ordinary ones. Without both classes, or
    where nothing sets them apart, no text passes.
    """
    import numpy as np

    y = np.array(y)
    if len(set(y.tolist())) < 2:
        return 0.0, float("inf"), 0.0
    quiet = float(np.quantile(np.concatenate([d for d, own in zip(differences, y) if not own]), QUIET))
    found = np.array([distance(d, quiet) for d in differences])
    bad, good = np.sort(found[y == 1]), np.sort(found[y == 0])
    tried = np.unique(found)
    tried = np.append((tried[1:] + tried[:-1]) / 2, tried[-1] + 1)
    worth = (len(bad) - np.searchsorted(bad, tried)) / len(bad) - ALARM * (len(good) - np.searchsorted(good, tried)) / len(good)
    best = tried[worth >= worth.max() - 1e-9]
    if worth.max() <= 0:
        return quiet, float("inf"), 0.0
    return quiet, float(best[0] + best[-1]) / 2, float(worth.max())


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit the dictionaries and thresholds on labelled rows outside fold 0.

    About TRAIN_TOXIC and TRAIN_ORDINARY rows are used (all, if there are fewer), chosen by a hash of the id, and of these
    no more than fit HELD_BYTES per class; they are read in one task. Null ids and labels are left out, of several labels of
    an id the largest counts, of several texts of an id the first in order; so repeated rows cannot make the sample larger.
    Without rows of both classes, as with empty tables, every text scores below one half. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where(F.crc32(F.col("id").cast("string")) % FOLDS != 0).groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    hashed = F.xxhash64(F.lit("train"), "id")
    chosen = known.where(((F.col("y") == 1) & sampled(hashed, TRAIN_TOXIC, n.get(1, 0))) | ((F.col("y") == 0) & sampled(hashed, TRAIN_ORDINARY, n.get(0, 0))))
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y").agg(F.min("text").alias("text")).select(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(CALIBRATE)).alias("part"), "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sets: dict[int, list] = {0: [], 1: []}
        later: list[tuple[int, str]] = []
        held = {(calibrating, y): 0 for calibrating in (True, False) for y in (0, 1)}
        for batch in batches:
            for p, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = text.as_py() if p == 0 else np.unique(codes(text.as_py()))
                size = len(own) if p == 0 else own.nbytes
                if held[p == 0, y] and held[p == 0, y] + size > HELD_BYTES:
                    continue
                held[p == 0, y] += size
                if p == 0:
                    later.append((y, own))
                else:
                    sets[y].append(own)
        best, model = -1.0, Model(b"", b"", 0.0, float("inf"))
        for toxic_size, ordinary_size in SIZES:
            toxic, ordinary = trained(sets[1], toxic_size), trained(sets[0], ordinary_size)
            differences = comparer(toxic, ordinary)
            quiet, least, worth = calibrate([differences(t) for _, t in later], [y for y, _ in later])
            if worth > best:
                best, model = worth, Model(toxic, ordinary, quiet, least)
        yield pa.RecordBatch.from_pylist([model._asdict()])

    row = sample.repartition(1).sortWithinPartitions(F.xxhash64("text"), "text").mapInArrow(run, "toxic binary, ordinary binary, quiet double, least double").first()
    if row is None:
        return Model(b"", b"", 0.0, float("inf"))
    return Model(bytes(row["toxic"]), bytes(row["ordinary"]), row["quiet"], row["least"])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """Add column ``into``: score of every whole text, 0 to 1; one half where its distance reaches the texts' threshold.

    The score depends on the text alone. Null texts score as empty ones, which stay below one half; rows, other columns
    and repeats pass through; a column of the name ``into`` is replaced.
    """
    toxic, ordinary, quiet, least = model
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import pandas as pd

        differences = comparer(toxic, ordinary)
        one = lambda text: float(1 - 0.5 ** (distance(differences(text), quiet) / least)) if np.isfinite(least) else 0.0
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype=float)

    return docs.withColumn(into, run(F.col(text_col)))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a model trained on the labels outside fold 0."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels), into="score")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
