"""The pipeline's stages and whole, on a small corpus."""

import corpus_pipeline as cp
from halyard.llm import common


def test_stages_keep_clean_documents_and_drop_planted_ones(spark, tmp_path):
    import random

    r = random.Random(1)
    stop = "the of and to in a is that it for was with on as be by this".split()
    text = lambda n: "\n".join(" ".join(r.choice(stop) if r.random() < 0.4 else "".join(r.choices("abcdefghij", k=6)) for _ in range(20)) for _ in range(n))
    clean = [text(6) for _ in range(30)]
    item = text(2)
    near = clean[3].rsplit(" ", 1)[0] + " changed"
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    docs += [(100, clean[0], "en", "s", 1), (101, near, "en", "s", 1), (102, text(2) + "\n" + item.replace("\n", " ") + "\n" + text(2), "en", "s", 1), (103, "12 34", None, "s", 1), (104, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = common.table(spark, str(tmp_path), "documents")
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == list(cp.COLUMNS), name
        assert set(range(30)) <= {x.doc_id for x in at.select("doc_id").collect()}, name
    assert {x.doc_id for x in at.collect()} == set(range(30))
    assert {x.doc_id for x in cp.run(spark, str(tmp_path)).collect()} == set(range(30))


def test_stages_take_repeated_rows_and_nulls(spark, tmp_path):
    """Rows are told apart by doc_id and text: a clean text that shares its doc_id with a copy stays."""
    import random

    r = random.Random(2)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(60))
    clean = [text() for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(None, text(), "en", "s", 1)]
    rows += [(20, clean[1], "en", "s", 1), (20, own := text(), "en", "s", 1), (3, clean[3], "en", "s", 1), (None, clean[4], None, None, None), (21, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    left = sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in cp.jaccard_join(spark, cp.line_dedup(spark, docs, str(tmp_path)).where("text != ''"), str(tmp_path)).collect())
    assert left == sorted([(False, i, t) for i, t in enumerate(clean)] + [(True, 0, rows[12][1]), (False, 20, own)])
    assert len(cp.run(spark, str(tmp_path)).collect()) == 14
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
