"""BPE encoding and decoding by tree concatenation (operator 10).

Short texts are encoded where they were read. A text longer than ``leaf_chars`` is cut into leaves
of that length, wherever the cut falls; the leaves are dealt over the cluster, encoded in parallel
and joined pairwise up a binary tree. At each join a window around the cut is encoded again and
grown until it shares a token (same start, end and id) with the left part and one with the right
part. A BPE sequence is right if each pair of neighbours is, and every pair of the joined sequence
then stands in the left part, the window or the right part, so the result equals encoding the whole.

The ids of one text are one value, so its last joins are one task's. Null texts count as empty, and null ids
are ids like others. An empty table gives an empty result. Rows with equal id and text give as many equal rows. Extra columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 32_768
#: Most distinct words a Python worker remembers; the memory starts anew when it is full.
CACHE_WORDS = 500_000
FIRST_WINDOW = 64
#: Words encoded in one call of the library.
BATCH_WORDS = 4096
#: How the vocabulary cuts words into pieces (a fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for plain words: printable ASCII with A-Z lowered, and the small letters of Latin-1, which neither case nor
#: normal form changes; and what makes a word another one.
PLAIN_CUT = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+)"
ODD = r"[^!-@\[-~ß-öø-ÿ]|<\|"
#: White space as blanks, and A-Z lowered with it.
_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_BLANKS_LOWER = _BLANKS.lower()  # bytes.lower changes A-Z only


def byte_letters() -> dict[int, str]:
    """The letters by which the vocabulary writes bytes: Latin-1's visible ones stand for themselves, all others
    get the letters from 256 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def joined(ids: pa.Array, lists: pa.Array) -> pa.Array:
    """The ids of each list's values as one value: their bytes stand next to each other already."""
    starts = np.frombuffer(ids.buffers()[1], "int64")[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, "int64")
    offsets = starts[np.asarray(lists.offsets) - (lists.offsets[0].as_py() if len(lists) else 0)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), (ids.buffers()[2] if len(ids) else None) or pa.py_buffer(b"")])


class WordEncoder:
    """Encodes text word by word with a remembered result for each word.

    Only ASCII white space separates words here: the vocabulary drops white space and never merges
    across it, so words are independent of each other. A-Z are lowered beforehand, as the vocabulary
    does itself, but not where a special token may stand, whose letters count as they are."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.cache_words, self.seen, self.pieces, self.letters = cache_words, {}, {}, byte_letters()
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]
        self.plain = self.tokenizer.decoder is None  # then decoding joins tokens by blanks
        self.cuts = json.dumps(CUT) in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"])

    def merged(self, piece: str) -> bytes:
        """The ids of one piece by the vocabulary's merges alone."""
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def in_library(self, words: list[str]) -> list[bytes]:
        """The ids of each word, many encoded in one call."""
        out = []
        for k in range(0, len(words), BATCH_WORDS):
            some = words[k : k + BATCH_WORDS]
            starts = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            ids, at = self.spans(" ".join(some))
            cuts = np.searchsorted(at[:, 0], [*starts, 2**62]) * 4
            raw = ids.astype("<u4").tobytes()
            out += [raw[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out

    def known(self, memory: dict[str, bytes], keys: list[str], encode: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """What is remembered of ``keys``, after the new ones have been encoded. A full memory starts anew."""
        new = [k for k in keys if k not in memory]
        if len(memory) + len(new) > self.cache_words:
            memory.clear()
            new = keys
        memory.update(zip(new, encode(new), strict=True))
        return pa.array(list(map(memory.__getitem__, keys)), pa.large_binary())

    def of_words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. Arrow cuts plain ones into pieces, which the vocabulary never merges with each
        other, and only distinct pieces are encoded; all other words go to the library."""
        odd = pc.match_substring_regex(words, ODD).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(words), bool)
        lists = pc.split_pattern(pc.replace_substring_regex(words.filter(~odd), PLAIN_CUT, r"\1 "), " ")
        pieces = lists.flatten().dictionary_encode()
        plain = joined(self.known(self.pieces, pieces.dictionary.to_pylist(), lambda x: list(map(self.merged, x))).take(pieces.indices), lists)
        others = self.known(self.seen, words.filter(odd).to_pylist(), self.in_library)
        place = np.where(odd, len(plain) - 1 + np.cumsum(odd), np.cumsum(~odd) - 1)
        return pa.concat_arrays([plain, others]).take(pa.array(place))

    def batch(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian 32-bit integers. Arrow cuts the texts into words and numbers the
        distinct ones, which alone are encoded. No text may be null."""
        texts = texts.cast(pa.large_string())
        at, data = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
        raw = bytes(memoryview(data)[at[0] : at[-1]]) if data else b""
        as_text = lambda x: pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(x))
        lower = as_text(raw.translate(_BLANKS_LOWER))
        if b"<|" in raw:  # a special token may stand there, whose letters count as they are
            lower = pc.if_else(pc.match_substring(texts, "<|"), as_text(raw.translate(_BLANKS)), lower)
        lists = pc.split_pattern(lower, " ")
        words = lists.flatten().dictionary_encode()
        return joined(self.of_words(words.dictionary).take(words.indices), lists)

    def ids(self, text: str) -> bytes:
        return self.batch(pa.array([text]))[0].as_py()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and start and end of each token in characters, by the library itself."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.asarray(e.ids, "<u4"), np.asarray(e.offsets, "int64").reshape(-1, 2)

    def decode(self, ids: np.ndarray) -> str:
        if self.plain:
            return " ".join(map(self.token.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def join(encoder: WordEncoder, text: str, cut: int, left: tuple, right: tuple, first: int = FIRST_WINDOW) -> tuple:
    """The encoding of ``text`` from the encodings (ids, spans) of text[:cut] and text[cut:], the
    spans counted from the start of text."""
    width = first
    while True:
        lo, hi = max(0, cut - width), min(len(text), cut + width)
        ids, at = encoder.spans(text[lo:hi])
        at = at + lo
        whole_left, whole_right = lo == 0, hi == len(text)
        mine = {(s, e, i): k for k, (i, (s, e)) in enumerate(zip(ids.tolist(), at.tolist(), strict=True))}

        def shared(part: tuple, back: bool) -> tuple[int, int] | None:
            """Index in the part and in the window of a shared token next to the window's edge; the
            token at the edge itself may be cut off there, so it does not count."""
            p_ids, p_at = part
            near = np.nonzero((p_at[:, 0] > lo) & (p_at[:, 1] <= cut) if back else (p_at[:, 0] >= cut) & (p_at[:, 1] < hi))[0]
            for k in near if back else near[::-1]:
                if (w := mine.get((int(p_at[k, 0]), int(p_at[k, 1]), int(p_ids[k])))) is not None:
                    return int(k), w
            return None

        a = (0, 0) if whole_left else shared(left, True)
        b = (len(right[0]), len(ids)) if whole_right else shared(right, False)
        if a and b and a[1] <= b[1]:
            return (
                np.concatenate([left[0][: a[0]], ids[a[1] : b[1]], right[0][b[0] :]]),
                np.concatenate([left[1][: a[0]], at[a[1] : b[1]], right[1][b[0] :]]),
            )
        width *= 2


def tree(encoder: WordEncoder, leaves: list[tuple[str, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Join encoded leaves pairwise until one is left; its ids."""
    level = [(t, (i, s)) for t, i, s in leaves]
    while len(level) > 1:
        up = []
        for k in range(0, len(level) - 1, 2):
            (t1, e1), (t2, (i2, s2)) = level[k], level[k + 1]
            up.append((t1 + t2, join(encoder, t1 + t2, len(t1), e1, (i2, s2 + len(t1)))))
        level = up + level[len(level) - len(level) % 2 :]
    return level[0][1][0]


def _row(encoder: WordEncoder, ids: bytes, with_ids: bool) -> tuple:
    text = encoder.decode(np.frombuffer(ids, "<u4"))
    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return (*row, np.frombuffer(ids, "<u4").astype("int64").tolist(), text) if with_ids else row


def encode(
    documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS, with_ids: bool = False
) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    ``with_ids`` also ids (array of long) and decoded. ``vocabulary`` is a tokenizers file of BPE that
    drops white space, at a path that every executor has."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    names = [x.split()[0] for x in out.split(", ")]
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(vocabulary)
        for frame in frames:
            rows = pd.DataFrame([_row(encoder, i.as_py(), with_ids) for i in encoder.batch(pa.array(frame["text"], pa.large_string()))], columns=names)
            yield pd.concat([frame[["doc_id"]].reset_index(drop=True), rows], axis=1)

    def each_leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(vocabulary)
        for frame in frames:
            got = [encoder.spans(t) for t in frame["text"]]
            yield frame.assign(ids=[i.tobytes() for i, _ in got], spans=[s.astype("<i4").tobytes() for _, s in got])

    made: list[WordEncoder] = []

    def joined(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(WordEncoder(vocabulary))
        leaves = leaves.sort_values("leaf", kind="stable")
        copies, one = int((leaves["leaf"] == 0).sum()), leaves.drop_duplicates("leaf")
        parts = [
            (t, np.frombuffer(i, "<u4"), np.frombuffer(s, "<i4").reshape(-1, 2).astype("int64"))
            for t, i, s in zip(one["text"], one["ids"], one["spans"], strict=True)
        ]
        row = (key[0], *_row(made[0], tree(made[0], parts).tobytes(), with_ids))
        return pd.DataFrame([row] * copies, columns=["doc_id", *names])

    n = F.length("text")
    short = docs.where(n <= leaf_chars).mapInPandas(whole, f"doc_id {id_type}, {out}")
    leaves = (
        docs.where(n > leaf_chars)
        .select("doc_id", F.xxhash64("text").alias("h"), n.alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{int(leaf_chars)}}}"), F.lit(0))).alias("leaf", "text"))
        .select("doc_id", "h", "n", "text", "leaf")
        .repartition("doc_id", "h", "leaf")
        .mapInPandas(each_leaf, f"doc_id {id_type}, h long, n int, text string, leaf int, ids binary, spans binary")
    )
    return short.unionByName(leaves.groupBy("doc_id", "h", "n").applyInPandas(joined, f"doc_id {id_type}, {out}"))
