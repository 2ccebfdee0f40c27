import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from driftwell.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    order = ["assign", "access", "hex"]
    return sorted(found, key=lambda x: (x[1], order.index(x[0])))


@pytest.fixture(scope="module")
def model(spark):
    prose = spark.createDataFrame([(1, "some plain words and a few more of them, as people write"), (2, None)], "id int, text string")
    return secrets.train(secrets.labelled_samples(spark, prose))


def texts():
    rng = random.Random(3)
    pieces = ["password", "Token", "api_key", "apikey", "=", ": ", "'", '"', "AKIA", "ABCDEFGH01234567", "deadbeef0123456789abcdef", "abc", "é漢\U0001f600", " ", "\n", "secret", "x.y=z"]
    return ["", None, "token=token:abcdefgh", "AKIAAKIA" + "A" * 13, "é password=abcdef é" * 3] + ["".join(rng.choice(pieces) for _ in range(n)) for n in (3, 9, 30, 200, 2000) for _ in range(8)]


def test_base_spans_equal_brute_force(spark, model):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "token: abcdef", 2), (3, "token: abcdef", 2), (3, "token: abcdef", 2)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digests(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, kind int"), model)).collect())
    want = []
    for i, t, _ in rows:
        b = brute(t or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        want.append((-1 if i is None else i, *[sum(x[0] == k for x in b) for k in ("assign", "access", "hex")], hashlib.sha256(said.encode()).hexdigest()))
    assert got == sorted(want)


def test_models_tell_random_from_ordinary(spark, model):
    ordinary = ["getUserAccountSettings", "the_long_parameter_name", "connection/handler/request", "Donaudampfschifffahrt", "documentation-and-testing"]
    random_ones = ["9aF3kQ0zX7bLp2Wd8TnV", "Zm9vYmFyMTIzNDU2Nzg5MGFiY2Q", "x7Kq-93jd_Lw0PzR4tYv"]
    df = spark.createDataFrame([(i, f"a {t} b") for i, t in enumerate(ordinary + random_ones)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.digests(secrets.scan(df, model)).collect()}
    assert [got[i] for i in range(len(ordinary))] == [""] * len(ordinary)
    assert all(got[len(ordinary) + i] == f"random:2:{2 + len(t)}" for i, t in enumerate(random_ones))


def test_redaction_and_empty_table(spark, model):
    df = spark.createDataFrame([(1, "a token=abcdef12 b", "found"), (2, "clean", "x"), (3, None, None), (1, "a token=abcdef12 b", "found")], "doc_id long, text string, found string").withColumn("_key", F.lit(1)).withColumn("_Found", F.lit(2))
    clean = secrets.redacted(df, model)
    assert clean.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in clean.collect())
    assert got == [(1, "a <secret> b"), (1, "a <secret> b"), (2, "clean"), (3, None)]
    assert secrets.digests(secrets.scan(df.limit(0), model)).count() == 0


def test_keys_inside_longer_tokens(spark, model):
    key, other = "9aF3kQ0zX7bLp2Wd8TnV", "Zq8RtW3xLk5JvB7nYd2M"
    cases = [
        (f"GET /api/v1/users/account/settings/{key} ok", [key]), (f"callback/session/{key}/account/index", [key]), (f"sk_live_{key}", [key]),
        (f"/users/{key}/account/settings/{other}/index/page", [key, other]), ("/api/v1/users/account/settings/documentation", []),
        ("Kq8RtW3xLk5JvB7nYd2MdeadBEEFdeadbeef0123456789abcdefQ7", ["Kq8RtW3xLk5JvB7nYd2MdeadBEEF", "deadbeef0123456789abcdef", "Q7"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: [tuple(s.split(":")) for s in r.spans.split(",") if s] for r in secrets.digests(secrets.scan(df, model)).collect()}
    assert [[cases[i][0][int(s) : int(e)] for _, s, e in got[i]] for i in range(len(cases))] == [want for _, want in cases]
    clean = {r.doc_id: r.text for r in secrets.redacted(df, model).collect()}
    assert clean[0] == "GET /api/v1/users/account/settings/<secret> ok" and clean[2] == "sk_live_<secret>"


def test_random_spans_equal_brute_force(spark, model):
    """The ratio and the stretches of each long token, from their definitions."""
    rng = random.Random(11)
    word = lambda: rng.choice(secrets.WORDS)
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    made = lambda: rng.choice(["/", "_", "-", ""]).join(rng.choice([word, word, lambda: key(rng.randint(3, 30)), lambda: word().upper()])() for _ in range(rng.randint(1, 7)))
    texts = [" ".join(made() for _ in range(rng.randint(1, 6))) for _ in range(150)]

    def ratio(t):
        return sum(model[128 * ord(a) + ord(b)] for a, b in zip(t, t[1:], strict=False)) / max(len(t) - 1, 1)

    def spans(t):
        if ratio(t) >= secrets.LIMIT:
            return [(0, len(t))]
        out, at, start, end, total = [], 0, 0, 0, 0.0
        for p in [*re.split("(?<=[/_-])", t), None]:
            if p is not None:
                core = re.sub("[/_-]$", "", p)
                over = (ratio(core) - secrets.LIMIT) * max(len(core) - 1, 0)
            if p is None or over < secrets.ORDINARY or total + over < 0:
                if end - start >= secrets.LEAST_STRETCH and total >= 0:
                    out.append((start, end))
                if p is not None:
                    at += len(p)
                    start, end, total = at, at, 0.0
            else:
                end, total = at + len(core), total + over
                at += len(p)
        return out

    base = {i: brute(t) for i, t in enumerate(texts)}
    got = {r.doc_id: {tuple(x.split(":")) for x in r.spans.split(",") if x.startswith("random")} for r in secrets.digests(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)).collect()}
    n = 0
    for i, t in enumerate(texts):
        want = {("random", str(m.start() + s), str(m.start() + e)) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t) for s, e in spans(m[0])}
        if not base[i]:
            assert got[i] == want, t
            n += len(want)
    assert n > 100


def test_identifiers_that_training_has_not_seen(spark, model):
    """Joined from words that the list has not: the share that is taken for random."""
    words = "harbor lantern meadow copper violin thunder kitchen blanket orchard puzzle cactus marble pepper saddle tunnel walnut anchor basket candle dragon".split()
    rng = random.Random(1)
    tokens = []
    for k in range(400):
        w = [rng.choice(words) for _ in range(4)]
        tokens.append(["_".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "-".join(w), "_".join(w).upper(), "/".join(w)][k % 5])
    got = secrets.digests(secrets.scan(spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string"), model)).where("spans <> ''").count()
    assert got <= 8
