"""Whitening, hard negatives and token files on small fixtures: brute force, round trips, and odd rows."""

from __future__ import annotations

import glob
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, odd_rows

from dayspans.llm import hard_negatives, token_files, whitening
from dayspans.llm._common import stash

VECTORS = "vec_id long, embedding array<float>, label int, row string, n long, x array<long>, part int, score double"


def odd_vectors(n=160, dims=9, seed=3):
    """Clusters, ties, repeats, nulls everywhere, short vectors, and columns that clash with inner names."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 6]], i % 5) for i in range(n)]
    rows += [(n + i, rows[10 + i % 3][1], i % 5) for i in range(20)]  # copies under other ids: ties
    rows += [rows[0], rows[50], rows[50]]  # repeated rows
    rows += [(400, None, 1), (401, [float("nan")] * dims, 1), (402, [1.0, None] * 4 + [0.0], 2), (403, [float("inf")] * dims, 2), (None, rows[3][1], 1), (None, rows[3][1], 2), (404, rows[4][1], None), (405, rows[5][1][:4], 3), (450, [], 0)]
    return [(*r, "r", 7, [1], 2, 0.5) for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return stash(spark.createDataFrame(odd_vectors(), VECTORS).repartition(3), "odd-vectors")


def fine(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def as_whole(v, dims, scale=256):
    x = np.floor(scale * np.array(v, np.float32).astype(float)).astype(int)
    return np.pad(x, (0, dims - len(x)))


# 11 Whitening


def test_whitening_matches_brute_force(vectors):
    rows = [(r[0], as_whole(r[1], 9)) for r in odd_vectors() if fine(r[1])]
    x = np.stack([v for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    got = whitening.whiten(vectors).collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-12
    signs = {}
    for c in range(1, 5):
        e, u = values[-c], basis[:, -c]
        want = sorted((str(i), int(((n * v - s) ** 2).sum()), float((v - s / n) @ u / e**0.5)) for i, v in rows)
        mine = sorted((str(r["vec_id"]), int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        sign = signs.setdefault(c, np.sign(sum(m[2] * w[2] for m, w in zip(mine, want))))
        assert max(abs(m[2] * sign - w[2]) for m, w in zip(sorted(mine, key=lambda t: (t[0], t[1], sign * t[2])), want)) < 1e-9
        assert {abs(r["explained"] - e / values.sum()) < 1e-12 for r in got if r["component"] == c} == {True}


@pytest.mark.parametrize("dims", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["full", "low rank", "equal", "close"])
def test_spectrum_slicing(dims, kind):
    rng = np.random.default_rng(dims)
    q, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
    given = {"full": rng.uniform(0, 9, dims), "low rank": np.r_[rng.uniform(1, 2, dims - dims // 2), np.zeros(dims // 2)], "equal": np.r_[np.full(min(3, dims), 5.0), np.ones(dims)][:dims], "close": 1 + 1e-10 * np.arange(dims)}[kind]
    a = q @ np.diag(given) @ q.T
    a = (a + a.T) / 2
    values, found = whitening.leading(a, 5)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:5]
    u = np.array(found)
    assert np.abs(np.array(values) - want).max() < 1e-12 and np.abs(u @ u.T - np.eye(len(u))).max() < 1e-12
    assert max(np.linalg.norm(a @ v - e * v) for e, v in zip(values, u)) < 1e-12
    for shift in rng.uniform(-1, 10, 12):
        assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


def test_inertia_needs_pivots_of_both_kinds():
    rng = np.random.default_rng(5)
    for d in (2, 3, 10, 31):
        a = rng.integers(-2, 3, (d, d)).astype(float)
        a = np.triu(a, 1) + np.triu(a, 1).T  # a zero diagonal
        assert whitening.above(a, 0.3) == (np.linalg.eigvalsh(a) > 0.3).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_whitening_of_few_or_large_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, []), (3, [None])])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] == 0 for r in one)
    line = whitening.whiten(frame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [3.0, 0.0])])).collect()
    assert sorted(r["component"] for r in line if r["whitened"] is None) == [2, 2, 2] and line[0]["identity_error"] < 1e-12
    big = [(i, [float(i * 2**46), float(-(i % 3) * 2**46)]) for i in range(9)]  # squares of up to 37 digits
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(frame(big), components=1).collect()}
    x = [[int(c) * 256 for c in v] for _, v in big]
    assert got == {i: sum((9 * v[j] - sum(w[j] for w in x)) ** 2 for j in range(2)) for i, v in enumerate(x)}
    with pytest.raises(ValueError, match="do not fit"):
        whitening.whiten(frame([(1, [1e300])]))


# 12 Hard negatives


def brute_negatives(rows, every, positives=5, negatives=3):
    known = [(r[0], r[2], as_whole(r[1], 9)) for r in rows if fine(r[1]) and r[2] is not None]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, label, x in known:
        if a is None or a % every:
            continue
        others = [(int(x @ y), b, own) for b, own, y in known if b != a]
        for p, pid, _ in sorted((o for o in others if o[2] == label), key=order)[:positives]:
            fits = sorted((o for o in others if o[2] != label and 50 * p <= 100 * o[0] <= 95 * p), key=order)[:negatives]
            out += [(a, pid, k + 1, nid, p, s) for k, (s, nid, _) in enumerate(fits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("block, cell", [(1 << 20, 8), (16 * 8 * 7, 1), (16 * 8 * 7, 3)])
def test_hard_negatives_match_brute_force(vectors, monkeypatch, block, cell):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", block // 2)
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    got = hard_negatives.mine(vectors, every=10).collect()
    want = brute_negatives(odd_vectors(), 10)
    assert len(want) > 100 and sorted(str(tuple(r)) for r in got) == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.integers(-400, 400, (30, 48)), rng.integers(-400, 400, (40, 48))
    fine_x, fine_y = (hard_negatives.summaries(v, 16) for v in (x, y))
    before = None
    for s in (4, 16):
        (m, d), (cm, cd) = hard_negatives.coarser(*fine_x, s), hard_negatives.coarser(*fine_y, s)
        direct = hard_negatives.summaries(x, s)
        assert np.allclose(m, direct[0]) and np.allclose(d, direct[1])
        middle, by = m @ cm.T * (48 // s), d @ cd.T * (48 // s)
        assert (np.abs(x @ y.T - middle) <= by + 1e-6).all()
        assert before is None or (by <= before + 1e-6).all()
        before = by


def test_hard_negatives_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(frame([])).count() == 0
    assert hard_negatives.mine(frame([(0, 1, None), (50, None, [1.0]), (100, 1, [])])).count() == 0
    assert hard_negatives.mine(frame([(0, 1, [1.0]), (1, 1, [1.0])])).count() == 0  # no other label
    got = hard_negatives.mine(frame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.95, 0.0]), (3, 2, [0.5, 0.0]), (4, 2, [0.96, 0.0]), (5, 2, [0.3, 9.0])])).collect()
    assert [tuple(r)[:4] for r in sorted(got)] == [(0, 1, 1, 2), (0, 1, 2, 3)]
    with pytest.raises(ValueError, match="may not fit"):
        hard_negatives.mine(frame([(0, 1, [1e12]), (1, 1, [1e12])]))


# 13 Token files


def whole_ids(texts, name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [e.ids + [2] for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers

    more = ["<|endoftext|>x <|startoftext|> it's I'LL", "á ́b c d e\x1cf\x85g", "ΑΣ Σ ΟΔΟΣ. İ", "x" * 5000, "é" * 3000 + " " * 3000 + "y", "\r\n\t \x0b\x0c z", "1234 !!?? don't", "한한"]
    rows = odd_rows() + [(100 + i, t, "en", "s", 1, 5, "r", "k", 3, "v", 0.5) for i, t in enumerate(more)]
    docs = stash(spark.createDataFrame(rows, SCHEMA).repartition(3), "token-docs")
    path = f"{tmp_path}/files"
    token_files.write_token_files(docs, path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), part_bytes=4_000, group_bytes=4_096, page_bytes=512, page_rows=5)
    got = sorted(token_files.checksums(token_files.read_documents(spark, path)).collect(), key=lambda r: r["start"])
    ids = whole_ids([r[1] for r in rows])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r[0]), len(x), crc(x)) for r, x in zip(rows, ids)) == sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got)
    assert [r["start"] for r in got] == [sum(q["n_tokens"] for q in got[:i]) for i in range(len(got))]
    # selective reads, and what lies in the files
    every = [i for r in sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    n = len(every)
    for first, last in [(0, 1), (0, n), (n // 3, n // 2), (n - 3, n + 50), (17, 17), (n, n + 1), (100, 101)]:
        span = sorted(token_files.read_span(spark, path, first, last).collect(), key=lambda r: r["start"])
        assert [i for r in span for i in r["ids"]] == every[first:last]
        assert all(every[r["start"] : r["start"] + len(r["ids"])] == r["ids"] for r in span)
    files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/tokens/*.parquet"))]
    columns = {m.row_group(0).column(i).path_in_schema: m.row_group(0).column(i) for m in files for i in range(m.num_columns) if m.num_row_groups}
    assert len(files) > 3 and all(c.has_offset_index and c.has_column_index for c in columns.values())
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings and all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("at", "stop", "doc_id"))
    plan = token_files.read_documents(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_token_files_whole_texts_and_none(spark, tmp_path):
    import public_tokenizers

    nothing = spark.createDataFrame([], SCHEMA)
    token_files.write_token_files(nothing, f"{tmp_path}/none", tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_documents(spark, f"{tmp_path}/none").count() == 0 and token_files.read_span(spark, f"{tmp_path}/none", 0, 9).count() == 0
    docs = spark.createDataFrame([(1, "two  words"), (0, None)], "doc_id long, text string")
    token_files.write_token_files(docs, f"{tmp_path}/whole", tokenizer=public_tokenizers.path("byte_bpe_50k.json"), by_word=False)
    got = {r["doc_id"]: list(r["ids"]) for r in token_files.read_documents(spark, f"{tmp_path}/whole").collect()}
    assert got == {0: [2], 1: whole_ids(["two  words"], "byte_bpe_50k.json")[0]}


def test_words_are_forgotten_beyond_a_bound(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "PIECES", 20)
    texts = [" ".join("ab"[j % 2] * j + chr(97 + i % 26) * (i + 1) for j in range(15)) for i in range(30)]
    encode = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, "<u4").tolist() + [2] for i in range(30) for x in encode(texts[i : i + 1])]
    assert got == whole_ids(texts) and len(encode.known) <= 60


def test_pieces_give_the_ids_of_whole_texts(spark):
    import public_tokenizers

    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["".join(chr(rng) for rng in random.Random(i).choices([*range(9, 14), *range(28, 128), *range(160, 600), 0x300, 0x3A3, 0x3C2, 0x1E9E, 0x2000, 0x2028, 0xFB01, 0x1F600], k=200)) for i in range(200)]
    encode = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() + [2] for x in encode(texts)] == whole_ids(texts)
