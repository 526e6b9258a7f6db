import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from cohortlens.llm import chat_format as cf

PATH = P.path("byte_bpe_50k.json")


def conversations():
    rng = random.Random(3)
    pieces = ["<|end|>", "<|text|>", "<|turn|>", "\\", "<", "|", "\\|", " hello", "  ", "\n", "é", "🙂", "### Assistant:", "</turn>", "<|endoftext|>", "x"]
    return [[(rng.choice(["user", "assistant", "system", "<|end|>", ""]), "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 6))] for _ in range(300)]


def test_escapes_are_exact():
    for turns in conversations():
        for role, text in turns:
            assert "<|" not in cf.escape(text) and cf.unescape(cf.escape(text)) == text
        assert cf.parse(cf.render(turns)[0]) == turns


def test_mask_gives_assistant_texts():
    t = cf.encoder(PATH)
    for turns in conversations():
        formatted, spans = cf.render(turns)
        e = t.encode(formatted, add_special_tokens=False)
        offsets = np.array(e.offsets).reshape(-1, 2)
        mask = cf.token_mask(offsets, spans)
        assert cf.masked_texts(formatted, offsets, mask) == "".join(x for r, x in turns if r == cf.LEARNED_ROLE)
        brute = [any(a < d and b > c for c, d in spans if c < d) for a, b in e.offsets]
        assert mask.tolist() == brute


def test_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, "assistant", " a<|end|>"), (2, 1, None, "b"), (2, 2, "assistant", "c\\"), (None, 0, "user", "x"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = cf.format_conversations(df, PATH)
    got = {r.conv_id: r for r in cf.conversation_digests(made).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(cf.render([(a, b) for _, a, b in turns])[0])
    for r in made.collect():
        assert len(r.ids) == len(r.loss_mask)
    assert cf.format_conversations(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("spans", [[], [(0, 0)], [(2, 5), (7, 9)]])
def test_binary_search_is_overlap(spans):
    offsets = np.array([(0, 2), (2, 3), (3, 6), (6, 7), (7, 9), (9, 10)])
    assert cf.token_mask(offsets, spans).tolist() == [any(a < d and b > c and c < d for c, d in spans) for a, b in offsets.tolist()]


def test_a_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|end|> " + "word " * (20_000 if i == 3 else 5)) for i in range(301)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = cf.format_conversations(df.selectExpr("*", "'x' AS ids", "'y' AS formatted", "1 AS loss_mask").repartition(5), PATH)
    (r,) = cf.conversation_digests(made).collect()
    loss = "".join(x for _, _, role, x in rows if role == "assistant")
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (301, len(loss), hashlib.sha256(loss.encode()).hexdigest())
