import random
from itertools import permutations

import duckdb
import pytest

from driftwell.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, texts):
    """The filters that a text fails, word by word."""
    words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    out += "D" if any(c in "#$%&*|" for c in text) else ""
    return out + ("E" if doc_id is not None and any(i is not None and i < doc_id for i in texts[text]) else "")


def brute(docs, labels):
    texts, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        texts.setdefault(t or "", []).append(i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = [(i, lang or "", fails(t or "", i, texts)) for i, t, lang in docs]
    out, removed_by = [], {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, own in enumerate(order, 1):
                gone = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                removed_by[part, own] = removed_by.get((part, own), 0) + len(gone)
                n_fail, unique = sum(own in f for _, f in mine), sum(f == own for _, f in mine)
                out.append([part, order, step, len(left), len(gone), n_fail - len(gone), unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(60):
        n = rng.choice([0, 3, 199, 200, 201, 260])
        pool = words if rng.random() < 0.5 else words[:90]
        text = rng.choice([" ", "\n", "\t\x0b "]).join(rng.choice(pool) for _ in range(n))
        text += " " + "A" * rng.choice([0, 0, 40]) + rng.choice(["", "", "|", "*"])
        docs.append((i, text, rng.choice(["en", "fr", "", None])))
    docs += [(100 + k, docs[k % 7][1], "en") for k in range(20)]  # copies, across parts
    docs += [(3, docs[3][1], "en"), (3, docs[3][1], "de"), (3, docs[3][1], "de")]  # one id again and again
    docs += [(None, docs[5][1], "en"), (None, None, None), (200, None, "fr"), (201, "", "fr"), (202, " \n", "fr"), (203, "é" * 97 + "ABC", "fr"), (204, "x y\x1cz" * 3, "fr")]
    docs.append((205, "long " * 300_000, "en"))
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, 1), (999, 1, 1)]
    return docs, labels


def test_equals_filters_in_order(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, a int")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_sql_says_the_same(spark):
    docs, labels = corpus()
    docs = [d for d in docs if d[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs[:-1])
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert sorted(con.execute(filter_audit.SQL).fetchall()) == brute(docs[:-1], labels)


def test_shapley_adds_up(spark):
    docs, labels = corpus()
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for part in {r.part for r in got}:
        one = [r for r in got if r.part == part and r.filter_order == "EDCBA"]
        assert sum(r.shapley for r in one) == 120 * sum(r.removed for r in one)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    one = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert filter_audit.audit(one, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 600
