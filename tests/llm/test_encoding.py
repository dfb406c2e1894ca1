from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import bpe
from fathomline.llm.encoding import TOKENIZER, corpus_tokens, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(TOKENIZER)


TEXTS = ["", " ", "a", "The  quick brown fox's 123 \n\n jumped...", "Für Ærø ﬁn ｆｕｌｌ е́ 日本 😀👩‍👩‍👧", "<|endoftext|> <|endoftext|>x", "  ​﻿­", "\t \n " * 50, "ab" * 3000, "x" * 5000, "'LL 'll it's we've", "１２３ 4½ ²", "ﬃ" * 70]


def test_whole_texts_match_the_library(own, reference):
    for t in TEXTS:
        assert own.encode_batch([t])[0] == reference(t), t[:40]
    assert own.encode_batch([None, "", "a"]) == [[], [], reference("a")]
    assert own.count_batch([None, *TEXTS]) == [0, *[len(reference(t)) for t in TEXTS]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file(TOKENIZER) if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    assert bpe.encoder(TOKENIZER).encode_batch([text])[0] == t.encode(text, add_special_tokens=False).ids


def naive(own, data):
    tokens = [int(own.byte_ids[b]) for b in data]
    while True:
        ranks = [(own.pairs.get(a * own.width + b, 1 << 60), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return tokens
        r, i = min(ranks)
        tokens[i : i + 2] = [int(own.by_rank[r])]


def test_both_trees_are_the_plain_merge_loop(own):
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b"abcdeing th\xc3\xa9 ") for _ in range(rng.randint(2, 60))) for _ in range(300)]
    want = [naive(own, p) for p in pieces]
    assert [own.encode_piece(p) for p in pieces] == want
    assert own.encode_many(pieces) == want


def test_store_is_emptied_when_full(reference, monkeypatch):
    small = bpe.ByteBPE(TOKENIZER)
    monkeypatch.setattr(bpe, "KEPT", 3)
    for t in ("one two three four", "five six seven", "one two"):
        assert small.encode_batch([t])[0] == reference(t)
    assert len(small.kept) <= 5


def test_table(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "a"), (101, "a"), (101, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, list(r.ids)) for r in token_ids(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(i, reference(t or "")) for i, t in rows], key=str)
    counts = sorted((r.doc_id or -1, r.tokens) for r in token_counts(df, "doc_id", "text").collect())
    assert counts == sorted((i or -1, len(reference(t or ""))) for i, t in rows)
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
    assert corpus_tokens(token_ids(df, "doc_id", "text")).agg(F.sum("n")).first()[0] == sum(len(x) for _, x in got)


def test_other_kinds_of_tokenizers_are_refused():
    from fathomline.llm.bpe import ByteBPE

    other = TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    with pytest.raises(ValueError, match="plain pre-tokenizer"):
        ByteBPE(other)
