"""Token ids as compressed binary files.

A token file set is a Parquet folder whose rows are blocks.  A block holds the zstandard frames
of up to BLOCK_DOCS documents, one frame for each document, and beside them an offset index:
document ids, frame offsets, id counts and each document's start within its shard.  Frames
share one dictionary, trained on a bounded sample of serialized id arrays; blocks carry its
hash, and the folder `<path>/dictionary` holds it.  A short document is read by finding its block
(doc_id range, which Parquet's statistics prune by) and decompressing its own frame alone.

Ids are serialized as little-endian unsigned integers, of 16 bits where the vocabulary (and the end
id) fits and else of 32; `width` in each block says which.

Order: blocks of shard s hold smaller document ids than those of shard s + 1 (range
partitioning), and within a shard documents ascend.  Writing goes through Spark's Parquet
committer, so a lost executor's tasks are run again and leave nothing behind.

Edge cases: null text is empty text (the end id alone); an empty table gives an empty file
set; repeated rows and ids stay, next to each other; null doc_id sorts first; a document larger than
BLOCK_BYTES gets a block of its own; other columns of the input are not looked at, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import chunks
from .common import arrow_batches, by_bytes, frugal, remembers

BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: The dictionary's training sample: at most so many documents, of each the first so many characters.  It decides how small the files get; what
#: they hold is all of every text.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1024, 4096, 32 << 10
#: Words that a worker remembers the ids of.
CACHE_WORDS = 350_000

_BLOCKS = (
    "shard int, block int, first_doc bigint, last_doc bigint, dict_hash string, width int, doc_ids array<bigint>, "
    "frame_offsets array<bigint>, n_tokens array<bigint>, starts array<bigint>, total bigint, frames binary"
)


#: Words that the tokenizer leaves as they are and takes as one piece each: lower-case Latin-1 letters, composed.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: An ASCII sign after a Latin letter begins a new piece.
_SIGN = re.compile(rb"[!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")


class WordEncoder:
    """Serialized ids of whole texts, from a tokenizer that lower-cases and treats words apart.

    The tokenizer collapses white space, never merges across it and ends each piece with a token
    that says so.  So a text's ids are the ids of its words in order; words recur, so most
    come from memory, and new plain words are encoded in one string and cut at those tokens.
    Texts that hold `<|` may spell special tokens, which depend on case; they are encoded whole."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(max(vocabulary.values()), end_id)
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if _PLAIN(t)]
        other = sorted({*range(len(words))} - {*plain})
        found = dict(zip([words[i] for i in other], self._ids([texts[i] for i in other]), strict=True))
        if plain:
            raw = self._ids([" ".join([texts[i] for i in plain])])[0]
            size = self.dtype.itemsize
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(raw, self.dtype)]) + 1) * size).tolist()
            found |= {words[i]: raw[a:b] for i, a, b in zip(plain, [0, *cuts], cuts, strict=False)}
            assert len(cuts) == len(plain), "each plain word ends once"
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        for chunk in chunks(texts):
            split = [None if "<|" in t else _SIGN.sub(rb" \g<0>", t.encode().lower()).split() for t in chunk]
            found = [None if ws is None else [*map(known.get, ws)] for ws in split]
            holes = [(f, ws, [i for i, ids in enumerate(f) if ids is None]) for f, ws in zip(found, split, strict=True) if f and None in f]
            fresh = self._new([*{ws[i] for _, ws, at in holes for i in at}])
            for f, ws, at in holes:
                for i in at:
                    f[i] = fresh[ws[i]]
            for text, f in zip(chunk, found, strict=True):
                yield (self._ids([text])[0] if f is None else b"".join(f)) + self.end
            if len(known) < CACHE_WORDS:
                known |= fresh


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    """This worker's encoder: what it remembers outlives a task."""
    return WordEncoder(path, end_id)


remembers("words", word_encoder.cache_clear)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text") -> bytes:
    """A dictionary from the documents whose ids hash lowest, SAMPLE_CHARS of each; b"" if they are too few or alike.

    The sample (4 MB at most) is encoded on the driver."""
    import zstandard

    key = F.xxhash64("doc_id")
    ids = docs.select("doc_id").orderBy(key, "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE_CHARS).alias("t"))
    texts = [r.t for r in sample.orderBy(key, "doc_id", "t").limit(SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [*word_encoder(tokenizer_path, end_id).encode(texts)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, text: str = "text", level: int = 1) -> None:
    """Encode docs (doc_id, text) and write the token file set at path.  One shuffle, of the
    texts by range of doc_id; a block's bytes are all that a worker holds."""
    spark = docs.sparkSession
    arrow_batches(spark)
    dictionary = train_dictionary(docs, tokenizer_path, end_id, text)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder = word_encoder(tokenizer_path, end_id)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        shard, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, frames, counts, starts = [], [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, held
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [shard, block, min(known, default=None), max(known, default=None), dict_hash, encoder.dtype.itemsize, ids[:], offsets, counts[:], starts[:], sum(counts), b"".join(frames)]
            block, held = block + 1, 0
            for x in (ids, frames, counts, starts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow_schema, strict=True)], schema=arrow_schema)

        for batch in (part for whole in batches for part in by_bytes(whole)):
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                if frames and (len(frames) >= BLOCK_DOCS or held + len(raw) > BLOCK_BYTES):
                    yield flush()
                n = len(raw) // encoder.dtype.itemsize
                ids.append(doc_id)
                frames.append(packer.compress(raw))
                held += len(frames[-1])
                counts.append(n)
                starts.append(start)
                start += n
        if frames:
            yield flush()

    longs = pa.list_(pa.int64())
    arrow_schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("dict_hash", pa.string()), ("width", pa.int32())]
        + [(c, longs) for c in ("doc_ids", "frame_offsets", "n_tokens", "starts")] + [("total", pa.int64()), ("frames", pa.binary())]
    )
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("doc_id", text).repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text)
    ranged.mapInArrow(frugal(compress, "words"), _BLOCKS).write.parquet(f"{path}/blocks")


def unpack(path: str, spark: SparkSession):
    """Dictionaries by hash, of the file set at path (one row each)."""
    return {r.dict_hash: bytes(r.dictionary) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked for) ids array<int>, from the files."""
    arrow_batches(spark)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one row for each shard, as many as the writer had partitions
    sums = blocks.groupBy("shard").agg(F.sum("total").alias("total")).collect()
    base, at = {}, 0
    for r in sorted(sums, key=lambda r: r.shard):
        base[r.shard] = at
        at += r.total
    dictionaries = unpack(path, spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        readers = {h: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None) for h, d in dictionaries.items()}
        for batch in (part for whole in batches for part in by_bytes(whole)):
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                frames, cuts, dtype, reader = row["frames"], row["frame_offsets"], np.dtype(f"<u{row['width']}"), readers[row["dict_hash"]]
                found = [np.frombuffer(reader.decompress(frames[a:b]), dtype) for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([base[row["shard"]] + s for s in row["starts"]], pa.int64()),
                    pa.array(row["n_tokens"], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                ]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    wanted = blocks.select("shard", "dict_hash", "width", "doc_ids", "frame_offsets", "n_tokens", "starts", "frames")
    return wanted.mapInArrow(frugal(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids: its block alone is read, its frame alone decompressed."""
    import zstandard

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    hit = blocks.filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id) & F.array_contains("doc_ids", doc_id))
    at = F.array_position("doc_ids", doc_id).cast("int")
    cut = hit.select("dict_hash", "width", F.substring("frames", F.element_at("frame_offsets", at).cast("int") + 1, (F.element_at("frame_offsets", at + 1) - F.element_at("frame_offsets", at)).cast("int")).alias("frame"))
    row = next(iter(cut.take(1)), None)
    if row is None:
        return None
    dictionary = unpack(path, spark)[row.dict_hash]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(reader.decompress(bytes(row.frame)), f"<u{row.width}").tolist()
