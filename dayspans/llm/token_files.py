"""Token ids in Parquet files: list columns with controlled encodings, row groups and page indexes.

Documents are dealt to parts by ranges of their ids, every part sorted, tokenised and written as one ordered sequence of
rows. A row holds a document's ids as a list column (dictionary encoded, for a vocabulary is small) and its place in the
part (delta encoded, for places only rise). Small row groups and pages with their indexes let a reader skip whatever a
filter on part, place or document rules out, and leave the ids unread where only lengths and places are asked for. Beside
the files lies a small table of the parts, made from the places alone: where each part starts among all tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import maybe_broadcast, stash_path

#: Token that ends every document.
END = 2
#: Bytes of text in one part, about; bytes of a row group and of a page; documents of a page, at most.
PART_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 1 << 25, 1 << 23, 1 << 16, 2_000
#: Pieces of words that a worker remembers with their ids, at most; longer ones are not remembered. Rows of one batch.
PIECES, LONGEST, ROWS = 400_000, 64, 500
#: Pieces that go through the library in one text.
CHUNK = 500
#: Characters that Python takes for white space and the tokenizers do not; white space in a text with one of them.
ODD, SPACES = re.compile(r"[\x1c-\x1f]"), re.compile(r"[\t\n\r ]+")
#: Runs of plain letters, single digits and runs of signs are pieces. Words with other characters, an apostrophe or a sign that
#: starts a special token go through the library by themselves.
PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ž]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ž0-9!-&(-/:;=-@\[-`{-~]+")
PLAIN_TEXT = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ž0-9!-&(-/:;=-@\[-`{-~\t-\r ]*")
SPECIAL = "<"
WORD_END = "</w>"


@lru_cache(maxsize=2)
def tokenizer_at(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class WordEncoder:
    """Texts -> their ids as little-endian bytes of 32 bits, each text without the end token.

    For tokenizers of whole words, which drop white space, ignore case, take letters, digits and signs apart and mark the
    end of each such piece in its last id: a text's ids are those of its pieces in a row. So each distinct piece goes
    through the library once, many in one text, which is cut at the ids that end a piece. ``by_word`` false gives whole
    texts to the library instead. A test holds both equal.
    """

    def __init__(self, path: str, by_word: bool = True):
        import numpy as np

        self.library, self.by_word = tokenizer_at(path), by_word
        self.known: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        if by_word and not all(t.content.startswith(SPECIAL) for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError(f"special tokens that do not start with {SPECIAL}: use by_word=False")

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some pieces, which the library sees as words of one text."""
        import numpy as np

        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(pieces):
            return self.whole(pieces)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def row(self, text: str) -> list[str]:
        """The pieces of a text, and its words that are not plain."""
        if PLAIN_TEXT.fullmatch(text):
            return PIECE.findall(text.lower())
        words = SPACES.split(text) if ODD.search(text) else text.split()
        return [p for w in words for p in (PIECE.findall(w.lower()) if PLAIN.fullmatch(w) else (w,))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > PIECES:
            self.known = {}
        rows = [self.row(t) for t in texts]
        new = set().union(*rows) - self.known.keys()
        plain = [p for p in new if PLAIN.fullmatch(p)]
        other = list(new.difference(plain))
        found = dict(zip(other, self.whole(other)))
        for i in range(0, len(plain), CHUNK):
            found.update(zip(plain[i : i + CHUNK], self.cut(plain[i : i + CHUNK])))
        once = {p: x for p, x in found.items() if len(p) > LONGEST}
        self.known.update(found)
        data = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        for p in once:
            del self.known[p]
        return data


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool) -> WordEncoder:
    """One encoder per worker, which keeps its pieces from task to task."""
    return WordEncoder(path, by_word)


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, by_word: bool = True, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path``/tokens and ``path``/parts.

    tokens: part, doc_id, at (tokens before the document in its part), stop (``at`` plus its own), ids. Parts, and rows
    within them, ascend by doc_id, null ids first, repeated ids by a hash of their text. A null or empty text is its end
    token alone; repeated rows are documents of their own; an empty table gives files without rows; other columns are not
    read. Texts are read whole. Parts are cut by rows, so that one id or text that a third of all rows have is spread.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ranged = rows.repartitionByRange(max(1, -(-size // part_bytes)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode, end, at = encoder(tokenizer, by_word), np.array([END], "<u4").tobytes(), 0
        part = TaskContext.get().partitionId()
        for whole in batches:
            for first in range(0, len(whole), ROWS):
                batch = whole.slice(first, ROWS)
                found = [x + end for x in encode(batch.column(1).to_pylist())]
                places = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype("i8")
                ids = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4").astype("i4")))
                cols = [pa.array(np.full(len(batch), part, "i4")), batch.column(0), pa.array(at + places[:-1]), pa.array(at + places[1:]), ids]
                at += int(places[-1])
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "stop", "ids"])

    tokens = ranged.select("doc_id", "text").mapInArrow(run, f"part int, doc_id {id_type}, at long, stop long, ids array<int>")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true"}
    tokens.write.options(**options).parquet(f"{path}/tokens")
    per = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("n_docs"), F.max("stop").alias("n_tokens"))
    start = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    per.select("part", "n_docs", "n_tokens", start.alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document. Without a use of ``ids``, only the places are read from the files."""
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))
    found = spark.read.parquet(f"{path}/tokens").join(maybe_broadcast(parts, parts.count()), "part")
    return found.select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), (F.col("stop") - F.col("at")).alias("n_tokens"), "ids")


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, ids): the tokens at places ``first`` to ``last`` - 1 among all, a row per document that has some.

    Filters on part and place reach the files, so that only the row groups and pages of the span are read.
    """
    tokens, parts = spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/parts")
    hit = parts.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    low, high = hit.agg(F.min(F.struct("part", "start")), F.max(F.struct("part", "start"))).first()
    if low is None or first >= last:
        return tokens.where(F.lit(False)).select("doc_id", F.col("at").alias("start"), "ids")
    inside = F.col("part").between(low["part"], high["part"])
    inside &= (F.col("part") > low["part"]) | (F.col("stop") > first - low["start"])
    inside &= (F.col("part") < high["part"]) | (F.col("at") < last - high["start"])
    starts = maybe_broadcast(hit.select("part", F.col("start").alias("part_start")), high["part"] - low["part"] + 1)
    found = tokens.where(inside).join(starts, "part").withColumn("begin", F.col("part_start") + F.col("at"))
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("begin")).cast("int")
    length = F.least(F.col("stop") - F.col("at"), F.lit(last) - F.col("begin")).cast("int") - skip
    return found.select("doc_id", (F.col("begin") + skip).alias("start"), F.slice("ids", skip + 1, length).alias("ids"))


def checksums(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents with their ids: the checksum of the ids as little-endian 32-bit numbers."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column(3)
            data, ends = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            sums = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            counts = np.diff(ends).astype("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents as token files, read back: each one's place, length and checksum."""
    import public_tokenizers

    path = stash_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return checksums(read_documents(spark, path))
