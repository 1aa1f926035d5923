"""The pipeline's stages on odd rows and on a given table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

import corpus_pipeline
from dayspans.llm import pii, toxicity
from dayspans.llm._common import stash

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stash(stage(spark, docs, DATA), "stage")
        kept[name] = docs
        if name != names[-1]:
            assert docs.dtypes == before.dtypes
    model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert toxicity.score(kept[names[0]], model).where("toxicity >= 0.5").count() == 0
    assert pii.detect(kept["PII"]).where(F.size("pii") > 0).count() == 0
    masked = kept["PII"].where("text like '%<EMAIL>%'").collect()
    assert all(not re.search(r"\w+@\w+\.\w", r["text"]) for r in masked)
    assert kept[names[3]].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = kept[names[4]]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert packed.where("piece = 0").count() == kept[names[3]].count()


def test_stages_take_odd_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b a@b.co", None, "s", 1), (2, "a b a@b.co", None, "s", 1), (3, "word " * 3000, "en", "t", None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stash(stage(spark, docs, DATA), "stage")


def test_toxicity_stage_leaves_clashing_columns_alone(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.9, "kept"), (2, None, None, None)], "doc_id long, text string, toxicity double, _toxicity string")
    got = corpus_pipeline.toxicity_stage(spark, docs, DATA)
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_matches_brute_force(spark, tmp_path):
    """The whole run against plain Python: what each stage keeps, masks, repeats and cuts."""
    import hashlib
    import math
    import random
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    import public_tokenizers
    from test_llm_operators import brute_components, n_words, near_copies, water_fill

    from dayspans.llm import packing

    rng, plain = random.Random(21), [f"wo{i}rd" for i in range(300)]
    rows = [(i, t) for i, t in near_copies(rng, 8, 6)]
    for i in range(1000, 1400):
        words = [rng.choice(plain) for _ in range(rng.randrange(12, 90))]
        for _ in range(3 if i % 4 == 0 else 0):
            words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "loserling"])
        if i % 7 == 1:
            words[2] = f"mail{i}@host.org"
        rows.append((i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "token " * 3000)]
    docs = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1) for i, t in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(1000, 1400)], "doc_id long, quality int, toxic int")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = toxicity.train(frame, labels)
    differences = toxicity.comparer(model.toxic, model.ordinary)

    def toxic(text):
        d = differences(text)
        return toxicity.distance(d, model.quiet) >= model.least

    source = {d[0]: d[3] for d in docs}
    kept = [(i, t) for i, t in rows if not toxic(t)]
    assert 60 < len(rows) - len(kept) <= 110
    kept = [r for r, (i, n, c) in zip(kept, brute_components(kept, 5, 80)) if not n or i == c]
    kept = [(i, t and re.sub(r"mail\d+@host\.org", "<EMAIL>", t)) for i, t in kept]
    sizes, streams, want = defaultdict(int), defaultdict(list), Counter()
    for i, t in kept:
        sizes[source[i]] += n_words(t)
        streams[source[i]].append((i, t, n_words(t)))
    targets, encode = water_fill(sizes), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for name, own in streams.items():
        key = {i: int(hashlib.md5(f"42:{i}:{n}".encode()).hexdigest()[:15], 16) for i, _, n in own}
        buckets, at, take = math.ceil(len(own) / max(256, math.sqrt(len(own)))), 0, math.floor(targets[name] + 0.5)
        for i, t, n in sorted((x for x in own if x[2]), key=lambda x: (key[x[0]] % buckets, key[x[0]], x[0])):
            copies = sum(at + lap * sizes[name] < take for lap in range(3))
            ids = [*encode(t).tolist(), packing.END]
            for p, (s, k) in enumerate(packing.cut(len(ids), 1024)):
                want[(i, p, s, k, zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes()))] += copies
            at += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 1024
