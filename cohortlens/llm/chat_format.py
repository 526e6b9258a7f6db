"""Chat formatting with offset-aligned loss masks.

Template: each turn is  <|turn|>role<|text|>text<|end|>  and turns follow each other.  Control
strings inside roles and texts are escaped: a backslash is doubled, and `<|` becomes `<\\|`;
so no escaped text holds `<|`, and unescaping is exact.

A whole conversation is encoded once, with character offsets; the control strings are special
tokens of the encoder, so no token crosses from a text into a control string.  A token is under
the loss mask if it overlaps an assistant's text: both lists of spans are sorted, so the
overlap is two binary searches for each span.

Edge cases: null role and null text are empty; rows with the same turn are ordered by role,
then text; repeated rows are turns of their own; a null conv_id is a conversation of its own; an empty table gives an empty result;
assistant turns without text put nothing under the mask; very long texts and conversations are encoded whole, so a conversation has to fit in
a task; columns other than the four are not looked at, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, frugal, remembers

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (offsets: n x 2, ascending) overlaps one of the (ascending) spans."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        cuts = np.array(spans)
        first = np.searchsorted(offsets[:, 1], cuts[:, 0], side="right")  # ends after the span's start
        last = np.searchsorted(offsets[:, 0], cuts[:, 1], side="left")  # starts before the span's end
        for (a, b), (lo, hi) in zip(spans, zip(first, last, strict=True), strict=True):
            mask[lo:hi] = a < b
    return mask


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """All text under the mask, unescaped: runs of masked tokens, cut out by their offsets."""
    if not mask.any():
        return ""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    cuts = ((int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edges[::2], edges[1::2], strict=True))
    return "".join(unescape(formatted[a:b]) for a, b in cuts)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A byte-level tokenizer with the control strings as special tokens, one for each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's leading space is part of its span
    t.encode_special_tokens = False
    t.add_special_tokens([AddedToken(s, normalized=False, special=True) for s in (TURN, TEXT, END)])
    return t


remembers("chat", encoder.cache_clear)


def format_conversations(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a conversation: conv_id, formatted string, ids array<int>, loss_mask
    array<boolean>, turns array<struct<role, text>> and loss_text, both read back from the output.

    The rows of a conversation are shuffled once by conv_id; a conversation is one output row and so
    has to fit in a task, other groups don't exist."""
    arrow_batches(rows.sparkSession)
    blank = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(tokenizer_path)
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string()]
        for batch in batches:
            made = [[] for _ in kinds]
            rendered = [render([(x["role"], x["text"]) for x in turns]) for turns in batch.column(1).to_pylist()]
            for (formatted, spans), e in zip(rendered, t.encode_batch([f for f, _ in rendered], add_special_tokens=False), strict=True):
                offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
                mask = token_mask(offsets, spans)
                back = [{"role": r, "text": x} for r, x in parse(formatted)]
                for column, value in zip(made, (formatted, e.ids, mask.tolist(), back, masked_texts(formatted, offsets, mask)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made, kinds)], ["conv_id", "formatted", "ids", "loss_mask", "turns", "loss_text"])

    return grouped.mapInArrow(frugal(run, "chat"), "conv_id bigint, formatted string, ids array<int>, loss_mask array<boolean>, turns array<struct<role: string, text: string>>, loss_text string")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 8 + 8 + 7 AS n
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
