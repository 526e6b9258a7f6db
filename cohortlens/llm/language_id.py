"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased.  A word is a run of letters and marks (of any plane), and every run of other characters counts as one
space on each side of a word; the 1-, 2- and 3-grams of words with their two spaces are hashed to buckets, but for the lone space.  No n-gram reaches
from one word into the next, so a text can be cut between words, and long texts are counted piece by piece.  Training
counts n-grams for each language (Python makes sparse counts of a partition, Spark sums
them); the log-probability matrix, buckets x languages, is a broadcast of at most MATRIX_CELLS floats: 2^15 buckets for up to 1,024
languages and fewer for more, however many labels there are.  Scoring counts the n-grams of a run of documents sparsely (document, bucket, count)
and multiplies by the matrix's rows, some languages at a time.

Only text and lang of the training rows are looked at.  The classifier is fitted on about
`per_lang` documents of each language (an expected number: those whose hash of id and text is low); every document is scored, over its
whole text.

Edge cases: null text and text without a letter get `und` with score 0; without training
rows every document is `und`; equal scores go to the language that sorts first; repeated rows are
scored one by one; a word of over CHUNK characters is cut there; an empty table gives an empty result; input columns named
lang_pred or score are replaced, others are passed on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_bytes, frugal

BITS, LEAST_BITS = 15, 10
#: Cells of the matrix that is broadcast (128 MB).
MATRIX_CELLS = 1 << 25
#: Training documents of each language, about.
PER_LANG = 10_000
#: Share of the uniform distribution that is mixed into a language's, the same for languages of few and of many documents.
SMOOTHING = 0.02
#: Code points that are counted at once, and cells of counts times languages.
CHUNK, CELLS = 400_000, 4_000_000
SPACE = 32


def bits_for(languages: int) -> int:
    """Buckets are 2 ** bits, so that the matrix stays within its bound."""
    return max(LEAST_BITS, min(BITS, (MATRIX_CELLS // max(languages, 1)).bit_length() - 1))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower case if it is a letter or mark, else a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: list[str]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Runs of (text's place, code points of it or of a piece), of about CHUNK code points; pieces end between words."""
    table, run, n = letters(), [], 0
    for place, text in enumerate(texts):
        code = table[code_points(text)]
        while len(code):
            end = len(code)
            if end > CHUNK:
                gaps = np.flatnonzero(code[:CHUNK] == SPACE)
                end = int(gaps[-1]) + 1 if len(gaps) else CHUNK
            if run and n + end > CHUNK:
                yield run
                run, n = [], 0
            run.append((place, code[:end]))
            code, n = code[end:], n + end
    if run:
        yield run


def grams(run: list[tuple[int, np.ndarray]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a run of pieces, and the piece (its place in the run) that each is of."""
    gap = np.full(1, SPACE, np.uint32)
    code = np.concatenate([part for _, c in run for part in (gap, c, gap)])
    piece = np.repeat(np.arange(len(run)), [len(c) + 2 for _, c in run])
    solid = code != SPACE
    # a space stays if a word begins or ends beside it; between two words it stays twice, as each has its own
    before, after = np.append(False, solid[:-1]), np.append(solid[1:], False)
    times = np.where(solid, 1, before.astype(np.int8) + after)
    code, piece = np.repeat(code, times), np.repeat(piece, times)
    solid = code != SPACE
    h = code * np.uint32(0x9E3779B1)
    buckets, owners = [], []
    for n in range(3):
        if n:
            h = h[:-1] * np.uint32(0x85EBCA6B) + (code * np.uint32(0x9E3779B1))[n:]
        m = len(h)
        # letters inside, spaces at most at the ends, and two spaces in a row are two words
        inside = solid[:m].copy() if n == 0 else solid[:m] | solid[1 : m + 1] if n == 1 else solid[1 : m + 1]
        mixed = h[inside] ^ (h[inside] >> np.uint32(15))
        buckets.append((mixed * np.uint32(0xC2B2AE35) + np.uint32(n)) >> np.uint32(32 - bits))
        owners.append(piece[:m][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log-probabilities (buckets x languages, float32)."""
    arrow_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col(text).isNotNull())
    # one row a language: labels, not documents
    counted = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counted)
    bits = bits_for(len(langs))
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32)
    # a threshold on a hash keeps about per_lang documents of each language, without a sort
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    unit = (F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    sample = rows.where(unit < shares[F.col("lang")]).select("lang", text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            for part in by_bytes(batch):
                by_lang: dict[str, list[str]] = {}
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(t)
                for lang, texts in by_lang.items():
                    for run in pieces(texts):
                        sums[lang] = sums.get(lang, 0) + np.bincount(grams(run, bits)[0], minlength=1 << bits)
                    if len(sums) << bits > MATRIX_CELLS // 4:
                        yield from rows()
        yield from rows()

    # at most MATRIX_CELLS sums, whatever the input's size
    sums = sample.mapInArrow(frugal(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(langs)), np.float32)
    counts[sums.bucket, sums.lang.map({lang: i for i, lang in enumerate(langs)})] = sums.n.to_numpy(np.float32)
    share = counts / np.maximum(counts.sum(axis=0, dtype=np.float64), 1)
    return langs, np.log((1 - SMOOTHING) * share + SMOOTHING / len(counts)).astype(np.float32)


def likelihoods(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each language (texts x languages)."""
    sums = np.zeros((len(texts), matrix.shape[1]))
    bits = len(matrix).bit_length() - 1
    for run in pieces(texts):
        bucket, piece = grams(run, bits)
        for first in range(0, len(run), 64):
            mine = (piece >= first) & (piece < first + 64) if len(run) > 64 else slice(None)
            counts = np.bincount((piece[mine] - first) << bits | bucket[mine].astype(np.int64))
            at = np.flatnonzero(counts)
            if not len(at):
                continue
            row, column, n = at >> bits, at & (1 << bits) - 1, counts[at].astype(np.float32)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            places = [run[first + int(r)][0] for r in row[starts]]
            step = max(1, CELLS // len(at))
            for k in range(0, matrix.shape[1], step):
                part = np.add.reduceat(matrix[column, k : k + step] * n[:, None], starts, axis=0, dtype=np.float64)
                np.add.at(sums[:, k : k + step], places, part)
    return sums


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior probability, for each text."""
    texts = [t or "" for t in texts]
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums = likelihoods(texts, matrix)
    best, shares = sums.argmax(axis=1), 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    known = [any(map(str.isalpha, t)) for t in texts]
    return [langs[b] if k else "und" for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(shares, known, strict=True)]


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, text: str = "text") -> DataFrame:
    """docs' columns without the text, and lang_pred, score (clashing ones are replaced)."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole)):
            names, scores = score_texts(batch.column(text).to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInArrow(frugal(run), schema)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang")
    langs, matrix = train(rows.where(~held_out(F.col("doc_id"))), per_lang)
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), langs, matrix)
