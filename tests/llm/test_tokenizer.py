"""Token ids against the public library on the same vocabulary: white space, scripts, emoji, contractions, special strings, long runs."""

import random

import pytest

from hyphae.llm.tokenizer import encode_corpus
from hyphae.session import prepare

tokenizers = pytest.importorskip("tokenizers")


def test_ids(spark):
    public = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rng = random.Random(7)
    parts = ["the", " vector", "  ", "\n", "\t", "\r\n", "'s", "'LL", "don't", "é", "é", "日本語の", "​", " ", "　", "😀", "👩‍🔬", "123", "4.5", "<|endoftext|>", "_", "--", "ﬁ", "ß", "﻿", "Ж", "ا", "#tag", "https://a.example/1"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(300)]
    texts += ["x" * 30_000, "ab" * 5_000 + " " * 3_000 + "c", " ", "\n\n", "a", "é" * 4_000, "0" * 2_000]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, "the"), (1002, "the")]
    df = prepare(spark).createDataFrame([(*r, [0]) for r in rows], "doc_id long, text string, ids array<int>").repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in encode_corpus(df).collect()}
    assert set(got) == {k for k, _ in rows} and got[1000] == got[1001] == []
    for (k, t), want in zip(enumerate(texts), public.encode_batch(texts, add_special_tokens=False)):
        assert got[k] == want.ids, repr(t[:80])
    assert encode_corpus(df.limit(0)).count() == 0
