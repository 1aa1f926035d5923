"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. They overlap: what one of them finds is mostly found by
another one too, by another statistic. Expectation-maximisation over the counts of vote patterns (all documents, but at
most as many patterns as the labellers can make) estimates from these agreements how each labeller votes on good and on
bad documents, and the share of good ones, without any true label. The posterior labels then train a linear scorer on
hashed features of the texts, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sampled
from .jaccard_join import mixed

#: Votes; labellers abstain between their two limits.
GOOD, BAD, NONE = 1, -1, 0
#: (statistic, bad below, good from, good up to, bad above).
LABELLERS = (
    ("n_words", 1, 30, 1e12, 1e13),
    ("mean_word", 1.5, 2.5, 9.0, 14.0),
    ("upper_share", -1.0, 0.0, 0.15, 0.5),
    ("upper_words", -1.0, 0.0, 0.1, 0.4),
    ("shout_share", -1.0, 0.0, 0.02, 0.2),
    ("symbol_share", -1.0, 0.0, 0.02, 0.08),
    ("pipe_share", -1.0, 0.0, 0.02, 0.1),
    ("letter_share", 0.75, 0.9, 1.0, 2.0),
    ("odd_words", -1.0, 0.0, 0.1, 0.3),
    ("distinct_share", 0.25, 0.4, 1.0, 2.0),
    ("same_next_share", -1.0, 0.0, 0.02, 0.2),
    ("repeat_share", -1.0, 0.0, 0.2, 0.4),
    ("dup_line_share", -1.0, 0.0, 0.2, 0.5),
    ("top_word_share", -1.0, 0.0, 0.15, 0.3),
)
#: Documents' worth of belief that EM starts from and is pulled to: on a bad document a labeller votes bad this often, on a good one that.
BELIEF, BAD_ON_BAD, BAD_ON_GOOD, SHARE_GOOD = 2.0, 0.3, 0.02, 0.8
#: Hashed features of a text; distinct texts that train the scorer, about; rounds of EM and of the fit.
DIMS, TRAIN_TEXTS, EM_ROUNDS, FIT_ROUNDS = 1_024, 8_000, 200, 250

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&<>{}~^=|\\@_")] = True


class Parts:
    """A text's bytes, its words as ranges and as hashes, and how often each word, run of four words and line occurs."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.data = np.frombuffer(self.raw, np.uint8)
        self.n_of = np.bincount(self.data, minlength=256)
        edges = np.diff(np.concatenate(([0], (~SPACES[self.data]).view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        lower = np.frombuffer(self.raw.lower(), np.uint8).astype(np.uint64) + np.uint64(1)
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(lower * np.cumprod(np.full(len(lower), base)))))
        back = np.cumprod(np.full(len(lower), inverse))
        self.words = mixed((sums[self.ends] - sums[self.starts]) * back[self.starts]) if len(self.starts) else np.empty(0, np.uint64)
        runs = np.zeros(max(len(self.words) - 3, 0), np.uint64)
        for j in range(4 if len(runs) else 0):
            runs = mixed(runs ^ self.words[j : j + len(runs)])
        lines = [hash(x) for x in self.raw.split(b"\n") if x.strip()]
        self.counts = [np.unique(x, return_counts=True)[1] for x in (self.words, runs, np.array(lines, np.int64))]

    def words_with(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of a kind each word has."""
        upto = np.concatenate(([0], np.cumsum(kind[self.data])))
        return upto[self.ends] - upto[self.starts]


def statistics(p: Parts) -> dict[str, float]:
    """Plain statistics of a whole text that the labellers look at; all are 0 for a text without words."""
    n = len(p.words)
    if not n:
        return {stat: 0.0 for stat, *_ in LABELLERS}
    upper = np.zeros(256, bool)
    upper[65:91] = True
    letters = max(int(p.n_of[65:91].sum() + p.n_of[97:123].sum()), 1)
    inner = int(p.n_of[~SPACES].sum())
    size = p.ends - p.starts
    twice = (p.data[1:] == p.data[:-1]) & ((p.data[1:] == 33) | (p.data[1:] == 63))
    words, runs, lines = p.counts
    return {
        "n_words": n,
        "mean_word": (inner - int(p.n_of[128:192].sum())) / n,
        "upper_share": int(p.n_of[65:91].sum()) / letters,
        "upper_words": float(((p.words_with(upper) == size) & (size > 1)).mean()),
        "shout_share": float(twice.sum()) / n,
        "symbol_share": int(p.n_of[list(b"#*$%&<>{}~^=")].sum()) / len(p.data),
        "pipe_share": int(p.n_of[124]) / n,
        "letter_share": int(p.n_of[LETTERS].sum()) / inner,
        "odd_words": float((p.words_with(SYMBOLS) > 0).mean()),
        # Vocabulary grows slower than a text: looked at over 200 words' worth.
        "distinct_share": min(1.0, len(words) / min(n, 200)),
        "same_next_share": float((p.words[1:] == p.words[:-1]).sum()) / n,
        "repeat_share": 1 - len(runs) / runs.sum() if len(runs) else 0.0,
        "dup_line_share": 1 - len(lines) / lines.sum(),
        "top_word_share": float(words.max()) / n if n >= 20 else 0.0,
    }


def votes(stats: dict[str, float]) -> list[int]:
    out = []
    for name, low, good_from, good_to, high in LABELLERS:
        v = stats[name]
        out.append(BAD if v < low or v > high else GOOD if good_from <= v <= good_to else NONE)
    return out


def features(p: Parts) -> np.ndarray:
    """Hashed features: shapes of four characters in a row, lengths of words, and how words, runs of four words and lines repeat."""
    data = p.data
    kind = np.where((data >= 97) & (data <= 122) | (data >= 128), 1, np.where((data >= 65) & (data <= 90), 2, np.where((data >= 48) & (data <= 57), 3, data.astype(np.int64)))).astype(np.int64)
    out, half = np.zeros(DIMS, np.float32), DIMS // 2
    if len(kind) >= 4:
        code = ((kind[:-3] * 131 + kind[1:-2]) * 131 + kind[2:-1]) * 131 + kind[3:]
        out[:half] = np.sqrt(np.bincount((code * 2654435761 >> 7) % half, minlength=half) / len(code))
    put = lambda what, values, share: np.add.at(out, half + (what * 7919 + values.astype(np.int64) * 104729) % half, np.sqrt(share).astype(np.float32))
    if len(p.words):
        length = np.bincount(np.minimum(p.ends - p.starts, 30))
        put(1, np.arange(len(length)), length / len(p.words))
    for what, n in enumerate(p.counts, 2):
        if len(n):
            often = np.bincount(np.log2(n).astype(np.int64), weights=n)
            put(what, np.arange(len(often)), often / n.sum())
    put(5, np.array([int(np.log2(len(p.words) + 1))]), np.ones(1))
    return out


def start_table() -> np.ndarray:
    """The belief that EM starts from, P(vote | class) as [labeller, class, vote + 1]: it says which class is the bad one."""
    table = np.empty((len(LABELLERS), 2, 3))
    for c, bad in enumerate((BAD_ON_GOOD, BAD_ON_BAD)):
        table[:, c] = bad, (1 - bad) / 4, (1 - bad) * 3 / 4
    return table


def em(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares of good and bad documents, P(vote | class) as [labeller, class, vote + 1]) from vote patterns and their counts.

    Every probability is estimated. The belief that EM starts from, worth BELIEF documents, keeps probabilities of unseen
    votes above 0.
    """
    start = start_table()
    table, share, balance = start, np.array([SHARE_GOOD, 1 - SHARE_GOOD]), np.array([SHARE_GOOD, 1 - SHARE_GOOD])
    for _ in range(EM_ROUNDS):
        p = posteriors(share, table, v) * n[:, None]
        share = (p.sum(0) + BELIEF * balance) / (n.sum() + BELIEF)
        cells = [[np.bincount(v[:, j] + 1, weights=p[:, c], minlength=3) for c in (0, 1)] for j in range(v.shape[1])]
        table = np.array(cells) + BELIEF * start
        table /= table.sum(2, keepdims=True)
    return share, table


def estimated(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """``em`` over a table of patterns (votes) and their counts (n), in one task: the labellers can make 3^14 patterns and no
    more, whatever the corpus, each of 14 bytes and a count. None without patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = [], []
        for batch in batches:
            v.append(batch.column(0).flatten().to_numpy().reshape(len(batch), -1).astype(np.int8))
            n.append(batch.column(1).to_numpy().astype(float))
        if sum(map(len, n)):
            share, table = em(np.concatenate(v), np.concatenate(n))
            yield pa.RecordBatch.from_pydict({"share": [share.tolist()], "cells": [table.ravel().tolist()]})

    row = patterns.repartition(1).sortWithinPartitions("votes").mapInArrow(run, "share array<double>, cells array<double>").first()
    return (np.array(row["share"]), np.array(row["cells"]).reshape(len(LABELLERS), 2, 3)) if row else None


def posteriors(share: np.ndarray, table: np.ndarray, v: np.ndarray) -> np.ndarray:
    """P(class | votes), a row per pattern."""
    logs = np.log(share) + np.stack([np.log(table[np.arange(v.shape[1]), c, v + 1]).sum(1) for c in range(len(share))], axis=1)
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(x: np.ndarray, p: np.ndarray, ridge: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels, by accelerated gradient steps."""
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(FIT_ROUNDS):
        ahead = w + np.float32(t / (t + 3)) * (w - last)
        miss = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30))) - p
        grad = np.append(x.T @ miss, miss.sum()) / len(x) + ridge * ahead
        last, w = w, (ahead - rate * grad).astype(np.float32)
    return w.astype(float)


def voted(docs: DataFrame, text_col: str) -> DataFrame:
    """Column ``votes`` (array of int) for every row."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: votes(statistics(Parts(t))))

    return docs.withColumn("votes", run(F.coalesce(F.col(text_col), F.lit(""))))


def train(docs: DataFrame, *, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scorer's weights, shares of good and bad, vote table). Uses no labels.

    EM counts the votes of all rows, so repeated rows count as often as they occur; the patterns of votes, of which
    there is a bounded number, meet in one task and never on the driver. The scorer fits on about TRAIN_TEXTS
    distinct texts, chosen by a hash of the text, each counted once however often it occurs: its features are made in
    parallel and gathered in one task. Null texts are empty ones. An empty table gives weights of 0, that is scores of
    one half; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = estimated(voted(docs.select(text.alias("text")), "text").groupBy("votes").agg(F.count("*").alias("n")))
    if found is None:
        return np.zeros(DIMS + 1), np.array([SHARE_GOOD, 1 - SHARE_GOOD]), np.full((len(LABELLERS), 2, 3), 1 / 3)
    share, table = found
    hashed = F.xxhash64(F.lit("fit"), text)
    n = docs.select(F.approx_count_distinct(hashed, 0.02)).first()[0]
    sample = docs.where(sampled(hashed, TRAIN_TEXTS, n)).select(text.alias("text")).distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [Parts(t) for t in batch["text"]]
            good = [posteriors(share, table, np.array([votes(statistics(p))]))[0, 0] for p in parts]
            yield pd.DataFrame({"x": [features(p).astype(np.float32).tobytes() for p in parts], "p": good})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(np.frombuffer(x, np.float32), p) for batch in batches for x, p in zip(batch["x"], batch["p"])]
        if got:
            yield pd.DataFrame({"w": [fit(np.array([x for x, _ in got]), np.array([p for _, p in got], np.float32)).tolist()]})

    row = sample.mapInPandas(measure, "x binary, p double").repartition(1).sortWithinPartitions("x").mapInPandas(learn, "w array<double>").first()
    return np.array(row["w"]) if row else np.zeros(DIMS + 1), share, table


def score(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", into: str = "quality_score") -> DataFrame:
    """Add column ``into``: score of every whole text, 0 to 1, higher for better.

    Null texts score as empty ones. Rows, repeats and other columns pass through; a column of the name ``into`` is replaced.
    """

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        z = np.array([float(features(Parts(t)) @ weights[:-1] + weights[-1]) for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(into, run(F.coalesce(F.col(text_col), F.lit(""))))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document and whether it is kept; no label is read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights, _, _ = train(docs)
    return score(docs, weights).select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))
