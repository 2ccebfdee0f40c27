import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftwell.llm import bpe, packing
from driftwell.llm.registry import vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def checked(rows, docs, library, window):
    """Every property that the pieces must have, from the rows alone."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            ids, at = want[i][0], 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
                assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0  # so nothing is padded
    return by_sequence


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiorstnlé") for _ in range(rng.randint(1, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 30, 80, 400])))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "  \n"), (503, "<|endoftext|> AB <|endoftext|>"), (504, "x" * 4000), (None, "a b c"), (505, docs[3][1])]
    return docs


@pytest.mark.parametrize(("window", "open_windows", "fan_in", "parts"), [(64, 4, 2, 7), (2048, 64, 8, 3), (16, 1, 3, 5)])
def test_pieces(spark, library, window, open_windows, fan_in, parts):
    docs = texts()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, task int, ids int").repartition(parts)
    rows = packing.pack(df, VOCABULARY, window=window, open_windows=open_windows, fan_in=fan_in).collect()
    by_sequence = checked(rows, docs, library, window)
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= total // window + window.bit_length()


def test_repeated_rows_and_other_ids(spark, library):
    docs = [("a", "one two"), ("a", "one two"), ("b", "three")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id string, text string"), VOCABULARY, window=8).collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)


def test_long_text_and_sequences(spark, library):
    text = "the quick brown fox " * 60_000
    df = spark.createDataFrame([(2**60 + 1, text), (2, "end")], "doc_id long, text string")
    pieces = packing.pack(df, VOCABULARY, with_ids=True)
    checked(pieces.collect(), [(2**60 + 1, text), (2, "end")], library, 2048)
    whole = packing.sequences(pieces).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in whole])
    assert sorted(ids.tolist()) == sorted([*library.encode(text, add_special_tokens=False).ids, 1, *library.encode("end", add_special_tokens=False).ids, 1])


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_fullest_is_emitted_and_best_fit_is_taken():
    p = packing.Packer(8, 2, 0)
    tokens = lambda n: b"\x00\x00\x00\x00" * n
    p.add("a", 0, tokens(5), 5)
    p.add("b", 0, tokens(6), 6)
    p.add("c", 0, tokens(2), 2)  # fills b's window exactly, not a's
    assert [(x[0], x[4], x[5]) for x in p.out] == [("b", 0, 0), ("c", 0, 6)]
    p.add("d", 0, tokens(4), 4)  # into the empty one
    p.add("e", 0, tokens(7), 7)  # fits nowhere: its head fills a's
    assert [(x[0], x[1], len(x[2]) // 4) for x in p.out[2:]] == [("a", 0, 5), ("e", 0, 3), ("d", 0, 4), ("e", 3, 4)]


def test_batches_equal_the_library(library):
    rng = random.Random(3)
    pool = "éüßÿ÷×ÉİſA abcdefgh'stredvmlABC0123456789!?.,-_'\"<>|&#$%*()[]{}~^`@ \x01\x7f\x1c\x85\xa0é漢"
    some = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a <|b A Hello É<|endoftext|>X", ""]
    e = bpe.WordEncoder(VOCABULARY, cache_words=500)
    for k in range(0, len(some), 400):
        for t, ids in zip(some[k : k + 400], e.batch(pa.array(some)[k : k + 400]), strict=True):
            assert np.frombuffer(ids.as_py(), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(e.batch(pa.array([], pa.string()))) == 0
