import hashlib
import random

import numpy as np
import pytest

from driftwell.llm import bpe
from driftwell.llm.registry import vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def sample_texts():
    rng = random.Random(5)
    pool = "abcdefgh'st  \n\t \x1ćéñİſ漢字12!?<|endoftext|>AB "
    texts = ["", " ", "x" * 3000, "ab" * 2500, "!" * 999 + "'s", "<|endoftext|>" * 300, "é" * 700, "It's we'll 'S 10,000 café"]
    texts += ["".join(rng.choice(pool) for _ in range(n)) for n in (1, 7, 99, 100, 101, 500, 3000)]
    texts += ["".join(rng.choice(["the", "ing", "a", "er", " ", "  ", "\n"]) for _ in range(n)) for n in (50, 400, 2500)]
    texts += ["".join(rng.choice(["the", "ing", "a", "er"]) for _ in range(n)) for n in (50, 400, 2500)]
    return texts


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return (
        len(ids),
        hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(),
    )


@pytest.mark.parametrize("leaf", [40, 97, 100_000])
def test_equals_library(spark, library, leaf):
    texts = sample_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(900, None, None), (None, "a b", "x"), (2, texts[2], "again"), (901, texts[2], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df, VOCABULARY, leaf_chars=leaf).collect())
    want = sorted((-1 if i is None else i, *expected(library, t or "")) for i, t, _ in rows)
    assert got == want


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_cache_stays_bounded(library):
    e = bpe.WordEncoder(VOCABULARY, cache_words=10)
    for k in range(50):
        text = f"word{k} other{k} third{k}"
        assert np.frombuffer(e.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(e.seen) <= 14
