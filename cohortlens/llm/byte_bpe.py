"""Byte-level BPE encoding and decoding.

The vocabulary comes as ranks (token bytes -> id).  A rank file has no merge list, so merges are
recovered: a token's merge is the pair that byte pair encoding of its own bytes, with lower
ranks only, ends in.  The `tokenizers` library then encodes Arrow batches; every piece that the
split pattern matches is encoded by itself, and special strings are ordinary text.

Decoding looks up each id's bytes and joins them; a character split over several ids is whole
again after the join.  `char_spans` maps ids to code point spans the same way: ids that share a split character all span it.

Edge cases: null text encodes as empty text (no ids); an empty table gives an empty result;
repeated rows are encoded independently; a very long text is split into pieces PIECES at a time, so a worker holds its ids and
no list of all its pieces; other columns of the input are not touched, and those that bear a name of the result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_bytes, frugal, remembers

#: Code points of text that are split at once; bounds a worker's memory.
CHUNK = 400_000
#: Pieces of a long text that are encoded at once.
PIECES = 100_000
#: Pieces that a worker remembers the ids of.
CACHE_PIECES = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: a byte that is a visible Latin-1
    character stands for itself, the others follow from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(shifted)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes the token; None if lower ranks can't build it."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A `tokenizers` definition with these ranks and this split pattern."""
    alphabet = byte_alphabet()
    name = lambda token: "".join(alphabet[b] for b in token)
    merges = [
        [name(pair[0]), name(pair[1])]
        for token in sorted(ranks, key=ranks.get)
        if len(token) > 1 and (pair := last_pair(token, ranks))
    ]
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": None,
            "model": {
                "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                "vocab": {name(token): rank for token, rank in ranks.items()}, "merges": merges,
            },
        }
    )


class ByteBpe:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], definition: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # of each id: the characters that begin in its bytes, whether it begins inside one, whether it is empty
        self.begun = np.array([sum(b & 0xC0 != 0x80 for b in t) for t in self.bytes], np.int64)
        self.inside = np.array([bool(t) and t[0] & 0xC0 == 0x80 for t in self.bytes], np.int64)
        self.solid = np.array([bool(t) for t in self.bytes], np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        ranks = read_ranks(path)
        return cls(ranks, tokenizer_json(ranks, pattern), pattern)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids (int32) of each text, a bounded number of characters at a time.

        Pieces are encoded each by itself and recur, so most ids come from memory."""
        for chunk in chunks(texts, CHUNK):
            if len(chunk[0]) <= CHUNK:
                yield from self._ids([self.pattern.findall(t) for t in chunk])
                continue
            found, matches = [], self.pattern.finditer(chunk[0])  # a chunk with a longer text is that text alone
            while split := [m.group() for m in islice(matches, PIECES)]:
                found += self._ids([split])
            yield np.concatenate(found) if found else np.empty(0, np.int32)

    def _ids(self, split: list[list[str]]) -> list[np.ndarray]:
        """The ids of lists of pieces."""
        known = self.known
        found = [[*map(known.get, ps)] for ps in split]
        holes = [(f, ps, [i for i, ids in enumerate(f) if ids is None]) for f, ps in zip(found, split, strict=True) if None in f]
        new = [*{ps[i] for _, ps, at in holes for i in at}]
        fresh = {p: np.array(e.ids, np.int32).tobytes() for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        for f, ps, at in holes:
            for i in at:
                f[i] = fresh[ps[i]]
        if len(known) < CACHE_PIECES:
            known |= fresh
        return [np.frombuffer(b"".join(f), np.int32) for f in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def char_spans(self, ids: np.ndarray) -> np.ndarray:
        """Code points [start, end) that each id takes part in, as two rows."""
        begun, inside = self.begun[ids], self.inside[ids]
        chars = np.cumsum(begun)
        # a continuation byte at the front belongs to the character begun before
        starts = chars - begun - inside
        return np.stack([starts, np.maximum(chars, starts + self.solid[ids])]).astype(np.int32)


_CODECS: dict[str, ByteBpe] = {}
remembers("codec", _CODECS.clear)


def codec(ranks: dict[bytes, int], definition: str, pattern: str) -> ByteBpe:
    """This worker's codec of a definition: what it remembers outlives a task."""
    key = hashlib.sha256(f"{pattern}\n{definition}".encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteBpe(ranks, definition, pattern)
    return _CODECS[key]


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[list[str]]:
    """The texts in order, in runs of about size characters."""
    run, n = [], 0
    for text in texts:
        if run and n + len(text) > size:
            yield run
            run, n = [], 0
        run.append(text)
        n += len(text)
    if run:
        yield run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs' columns without the text, and n_tokens long, ids_sha256 string (decimal ids, one space between), decoded_sha256 string,
    offsets_crc32 long (of starts and then ends, little-endian 32-bit); before them, if asked for, ids array<int> and their offsets in code
    points, starts and ends array<int>.

    One narrow pass; the rank table (under 1 MB) goes to the workers with the task."""
    spark = docs.sparkSession
    arrow_batches(spark)
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, tokenizer_json(ranks, pattern), pattern))
    kinds = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "offsets_crc32": "bigint"}
    made = [c for c in kinds if ids or kinds[c] != "array<int>"]
    kept = [c for c in docs.columns if c != text and c not in made]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {kinds[c]}" for c in made])

    def lists(rows: list[np.ndarray], sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        bpe = codec(*shared.value)
        decimal = [str(i) for i in range(len(bpe.bytes))]
        for batch in (part for whole in batches for part in by_bytes(whole)):
            arrays, spans, digests, back, crcs = [], [], [], [], []
            for found in bpe.encode([t or "" for t in batch.column(text).to_pylist()]):
                one, span = found.tolist(), bpe.char_spans(found)
                digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, one)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(one)).hexdigest())
                crcs.append(zlib.crc32(span.tobytes()))
                arrays.append(found if ids else len(found))
                if ids:
                    spans.append(span)
            sizes = np.array([len(x) for x in arrays] if ids else arrays, np.int64)
            columns = [lists(x, sizes) for x in (arrays, [s[0] for s in spans], [s[1] for s in spans])] if ids else []
            columns += [pa.array(sizes), pa.array(digests, pa.string()), pa.array(back, pa.string()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, kept + made)

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(frugal(run, "codec"), schema)
