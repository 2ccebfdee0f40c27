import random
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from driftwell.llm import decontaminate


def test_leaks(spark):
    rng = random.Random(4)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    q1, q2 = w(25), "a train with Tom leaves at 14 and travels 250 km before it meets the second train, which Tom said had left at 14 from the coast"
    items = [(1, q1), (2, q2), (3, None), (4, "too short"), (5, ""), (1, q1)]
    swapped = q2.replace("Tom", "Anna").replace("14", "9:30").replace("250 km", "1,200 miles")
    mixed = "a train with Eve leaves at 1 and travels 2 km before it meets the second train, which Bob said had left at 7 from the coast"
    docs = {1: f"{w(30)} {q1} {w(9)}", 2: w(80), 3: f"{w(5)} {swapped}. {w(20)}", 4: mixed, 5: q1.upper(), 6: w(6), 7: "", 8: None, 9: q1.split(" ", 15)[-1] + " " + w(30), 10: q2}
    rows = [(i, t, 5) for i, t in docs.items()] + [(1, docs[1], 6), (None, q1, 7)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string, pos int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 1), (10, 2), (None, 1)}
    assert got[1, 1].covered == 100 and got[1, 1].consistent == 100
    assert got[3, 2].consistent == 100 and got[3, 2].covered == 100
    kept = decontaminate.filtered(spark.createDataFrame(rows, "doc_id long, text string, pos int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {2, 4, 6, 7, 8, 9}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(d, b).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([(1, "x " * 20)], d.schema), b).count() == 0


def test_each_occurrence_counts_alone(spark):
    rng = random.Random(5)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    q = "a train with Tom leaves at 14 and travels 250 km before it meets the second train, which Tom said had left at 14 from the coast"
    versions = [q.replace("Tom", n).replace("14", t).replace("250", k) for n, t, k in (("Anna", "9", "30"), ("Eve", "11", "77"), ("Bob", "3", "41"))]
    torn = "a train with Eve leaves at 1 and travels 2 km before it meets the second train, which Bob said had left at 7 from the coast"
    row = "then he puts {} red apples into the same old box and"
    again = " ".join(row.format(n) for n in (3, 5, 8))
    cut = [v.replace("before it", "before really it") for v in versions]
    docs = {
        1: f"{w(9)} {q} {w(30)} {versions[0]} {w(12)} {versions[1]}", 2: f"{w(5)} {w(40).join(versions)} {w(8)}", 3: torn, 4: f"{w(9)} {again} {w(9)}",
        5: f"{torn} {w(50)} {q}", 6: f"{w(40).join(cut)} {w(3)}", 7: f"{w(20)} {torn} {w(9)} {torn}",
    }
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, q), (2, again)], "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (5, 1), (6, 1)}
    assert all(got[k].covered == 100 and got[k].consistent == 100 for k in got if k != (6, 1))
    assert got[6, 1].covered > 80 and got[6, 1].consistent == 100


def parts(t):
    """Words and templates of a text, from the definitions."""
    tpl = regex.sub(r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "\ue001", t)
    tpl = regex.sub(r"\p{N}(?:[.,:]?\p{N})*", "\ue002", tpl)
    units = "|".join(sorted(decontaminate.UNITS, key=len, reverse=True))
    tpl = regex.sub(rf"(?<=\ue002[ \t\n\x0b\f\r]?)(?i:{units})(?![\p{{L}}\p{{N}}])", "\ue003", tpl)
    bare = lambda x: regex.sub("[^\\p{L}\\p{N}\\p{M}\ue001-\ue003 \t\n\x0b\f\r]+", "", x).lower().split()
    return bare(t), bare(tpl)


def brute(doc, item):
    """covered and consistent of each diagonal of an item in a document, from the definitions."""
    (dr, dt), (ir, it) = parts(doc), parts(item)
    slot = lambda w: any(x in w for x in "\ue001\ue002\ue003")
    if len(ir) < 8:
        return [(100, 100)] if ir and any(dr[k : k + len(ir)] == ir for k in range(len(dr))) else []
    hits = defaultdict(set)
    for i in range(len(ir) - 7):
        for d in range(len(dr) - 7):
            if dr[d : d + 8] == ir[i : i + 8] or (dt[d : d + 8] == it[i : i + 8] and sum(not slot(w) for w in it[i : i + 8]) >= 4):
                hits[d - i] |= set(range(i, i + 8))
    out = []
    for diagonal, at in hits.items():
        pairs = [(ir[i], dr[i + diagonal]) for i in at if slot(it[i])]
        lost, held = [0, 0], 0
        for side in (0, 1):
            images = defaultdict(Counter)
            for p in pairs:
                images[p[side]][p[1 - side]] += 1
            lost[side] = sum(c.total() - max(c.values()) for c in images.values())
            held += sum(max(c.values()) - 1 for c in images.values())
        bad = lost[0] + max(0, lost[1] - 1)
        out.append((100 * len(at) / len(ir), 100 if not bad else 100 * held / (held + bad)))
    return out


@pytest.mark.parametrize("rows", [10**6, 0])
def test_equals_brute_force(spark, rows, monkeypatch):
    """Items of all lengths, whole or as re-parameterised versions; with the hashes broadcast or not."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    name, number, unit = lambda: word().capitalize(), lambda: str(rng.randint(1, 9999)), lambda: rng.choice(["km", "hours", "kg", "percent"])
    def filled(form, same):
        slots, out = {}, []
        for f in form:
            if isinstance(f, str):
                out.append(f)
            else:
                kind, k = f
                make = {"n": name, "x": number, "u": unit}[kind]
                out.append(slots.setdefault(f, make()) if same else make())
        return " ".join(out)

    forms, items = [], []
    for i in range(40):
        n = i // 4 + 1 if i < 30 else rng.randint(12, 50)
        share = 0.95 if i % 5 == 4 else 0.3
        form = [rng.choice([("n", rng.randint(0, 2)), ("x", rng.randint(0, 2)), ("u", 0)]) if rng.random() < share else word() for _ in range(n)]
        forms.append(form)
        items.append((i, filled(form, True) + rng.choice(["", ".", "?"])))
    docs = []
    for k in range(120):
        form = forms[k % 40]
        own = items[k % 40][1] if k < 40 else filled(form, k % 3 > 0)
        if k % 7 == 0:
            own = own.upper() if k % 2 else own.lower()
        filler = lambda: " ".join(rng.choice([word, word, word, name, number])() for _ in range(rng.randint(0, 25)))
        docs.append((k, f"{filler()} {own} {filler()}"))
    want = {(d, i) for d, t in docs for i, q in items if any(c >= 50 and s >= 50 for c, s in brute(t, q))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, k) for k in range(40)} <= want
    assert got >= want  # several diagonals may make up one occurrence, so there may be a few more
    assert all(len(brute(docs[d][1], items[i][1])) > 1 for d, i in got - want)


def test_values_that_become_one(spark):
    q = "first Anna bought 3 pens and then Bob sold 5 cups while later Carla took 8 plates home to the old house by the river"
    one = q.replace("Anna", "Eve").replace("Bob", "Eve").replace("Carla", "Eve").replace("3", "7").replace("5", "7").replace("8", "7")
    chance = q.replace("Anna", "Eve").replace("Bob", "Tom").replace("Carla", "Kim").replace("3", "7").replace("5", "7").replace("8", "9")
    docs = spark.createDataFrame([(1, one), (2, chance)], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, spark.createDataFrame([(1, q)], "item_id long, text string")).collect()] == [2]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    q = w(40)
    got = decontaminate.leaks(spark.createDataFrame([(1, f"{w(60_000)} {q} {w(60_000)}")], "doc_id long, text string"), spark.createDataFrame([(1, q)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.covered) for r in got] == [(1, 100)]


@pytest.mark.parametrize("unit", ["7", "1,", "2.5:"])
def test_endless_numbers(spark, unit):
    """A million digits, with and without marks between them, are one number."""
    question = "how many of the {} red apples does the farmer sell on market day"
    many = unit * (1_000_000 // len(unit)) + "1"
    docs = spark.createDataFrame([(1, question.format(many)), (2, many), (3, "nothing of the kind here")], "doc_id long, text string")
    items = spark.createDataFrame([(5, question.format("12"))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, 5)]


def test_templates(spark):
    """Names, numbers and units against the patterns one by one."""
    texts = ["1,234.5 a 3:4 5. 6 7,8", "x1 2y 3..4 5,,6 .7 8.", "١٢٣,٤ ½ 9", "", "1.2.3,4:5", None, "3km 3 KM 3  km 3\tkm4 5kms Km 7Km", "Tom-Tim Ab9 9Ab éCole École de Bern m 4 m", "\ue0014\ue004 km \ue002", "ΑΣ3 ΑΣ İx"]
    rng = random.Random(8)
    bits = ["Tom", "Ab", "a", "É", "ß", "3", "1,2", "4.", "km", "Min", "hrs", "%", "-", " ", " ", "\n", "\t ", "'", "\u0301"]
    texts += ["".join(rng.choice(bits) for _ in range(40)) for _ in range(400)]
    rows = decontaminate.templated(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    strip = lambda t: regex.sub("[\ue001-\ue004]", "", t or "")
    assert [(r.raw, r.tpl) for r in rows] == [parts(strip(t)) for t in texts]


def test_hashes_of_words_are_those_of_templates_and_plain_words(spark):
    texts = ["Alice paid 12.5 km, twice.", "abc5def 3kg -- A1b", "", None, " \n\t", "x Zoë met BOB at 7pm", "Ann's 3 Dogs"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    of = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    want = decontaminate.templated(df, "t").select(of("raw"), of("tpl")).collect()
    assert decontaminate.hashed(df, "t").select("hr", "ht").collect() == want


def test_windows_are_rows_of_equal_words(spark):
    df = spark.createDataFrame([(1, " ".join("abcdefghi")), (2, "x " + " ".join("bcdefghi")), (3, "a b c")], "doc_id long, t string")
    got = decontaminate.windowed(decontaminate.hashed(df, "t"), "doc_id").collect()
    assert sorted((r.doc_id, r.pos) for r in got) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    by = {(r.doc_id, r.pos): r.wr for r in got}
    assert by[1, 1] == by[2, 1] and by[1, 0] != by[2, 0] and all(r.wt == r.wr for r in got)
