import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framewise.llm import tokenise

PATH = tokenise.TOKENIZERS + "/byte_bpe_50k.json"
TEXTS = ["", None, "  ", "Hello world", "don't  stop\r\n\n", "<|endoftext|> is text", "zzzzzzzz" * 300, "ああああ" * 200, "กัปตันไม่เคย", "👍🏿𓀀👨‍👩‍👧", "á é", "12345 67", "x" * 30_001]


@pytest.fixture(scope="module")
def other():
    with open(tokenise.TOKENIZERS + "/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenise.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_another_implementation_and_decode_back(spark, other):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r.doc_id: list(r.ids) for r in tokenise.encode_column(df, ["doc_id"]).collect()}
    assert rows == {k: other.encode_ordinary(t) if t else [] for k, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokenise.decode_column(tokenise.encode_column(df, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    sizes = {r.doc_id: r.n_tokens for r in tokenise.encode_column(df, ["doc_id"], sizes_only=True).collect()}
    assert sizes == {k: len(v) for k, v in rows.items()}


def test_empty_table(spark):
    assert tokenise.encode_column(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(other, text):
    assert tokenise.BpeEncoder.at(PATH).encode([text])[0] == other.encode_ordinary(text)


def test_long_words_without_breaks(other, monkeypatch):
    import random

    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=4_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)), "ab" * 20_000]
    assert tokenise.BpeEncoder.at(PATH).encode(words) == [other.encode_ordinary(w) for w in words]
    monkeypatch.setattr(tokenise, "STEPS", 2)
    fresh = tokenise.BpeEncoder(PATH)
    assert fresh.encode(words[:1]) == [other.encode_ordinary(words[0])]
