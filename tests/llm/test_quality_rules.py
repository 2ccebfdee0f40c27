import random
import re
from collections import Counter

from driftwell.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    marked = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, " \n\t ", "a", "x\n\nx\nx \n", "é漢 \U0001f600|#", "w " * 3000, " ".join("abcdefgh" * 2)]
    for n in (5, 8, 9, 40, 300):
        texts += ["".join(rng.choice(["aa ", "b\n", "c\t", "dé ", "#|", "e\x0b", "f\r\n"]) for _ in range(n)) for _ in range(6)]
    df = spark.createDataFrame([(i, t, "h", "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, host string").drop("host")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), repr(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_hosts(spark):
    good = lambda k: " ".join(f"word{k}x{i}" for i in range(30))
    rows = [(k, good(k), "good") for k in range(30)] + [(100 + k, "short" if k < 28 else good(k), "bad") for k in range(30)]
    rows += [(200, "short", "new"), (201, good(201), "new"), (202, good(202), None), (None, good(203), "good"), (1, good(1), "good")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kept boolean")
    got = quality_rules.judge(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.kept} == {*range(30), 201, 202, None}
    kept = quality_rules.filtered(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(30), 1, 201, 202, None])
    assert quality_rules.judge(df.limit(0)).count() == 0
