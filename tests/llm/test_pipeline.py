import random

import corpus_pipeline
from driftwell.llm import near_dedup


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item, base = w(30), w(200)
    docs = {1: base, 2: base + " end", 3: w(100), 4: f"{w(40)} {item} {w(40)}", 5: w(50) + " password=abcdef123456 " + w(20), 6: "too short", 7: None, 8: "", 9: w(60) + " " + "la " * 100}
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
        assert k == 4 or now.columns == columns
        if k == 3:
            text = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    assert ids == [{1, 2, 3, 4, 5}, {1, 3, 4, 5}, {1, 3, 5}, {1, 3, 5}, {1, 3, 5}]
    assert text[3] == (docs[3], len(docs[3])) and "<secret>" in text[5][0] and "abcdef123456" not in text[5][0] and text[5][1] == len(text[5][0])
    final = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {r.doc_id: r.ids_sha256 for r in now.collect()}
    assert near_dedup.words("A b") == [b"a", b"b"]


def test_edge_rows(spark, tmp_path):
    """Repeated rows, rows without an id, null and empty texts, extra columns of clashing names, and no rows."""
    rng = random.Random(7)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    one, two, three = w(120), w(120), w(120)
    rows = [(1, one), (1, one), (2, two), (None, three), (None, three), (None, one), (3, None), (4, ""), (None, None), (5, w(5000))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, words string, n_words int"
    df = spark.createDataFrame([(i, t, "en", None, None, "c", 1, "w", 2) for i, t in rows], kind)
    spark.createDataFrame([(1, w(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs, want in (("some", df, [(None, three), (1, one), (2, two), (5, rows[-1][1])]), ("none", df.limit(0), [])):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        (tmp_path / name / "benchmark.parquet").symlink_to(tmp_path / "benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == sorted(want, key=str)
        assert corpus_pipeline.run(spark, folder).count() == len(want)
