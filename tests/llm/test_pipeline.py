"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline as pipeline
from glyphframe.llm import quality

from .test_duplicates import brute_cut, brute_groups, brute_lines
from .test_tokens import _check_packed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.dtypes
    good = pipeline.stored(pipeline.keep_good(spark, docs, SF))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.dtypes == columns and all(before[i] == t for i, t in kept.items())
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) / len(clean) > 0.95

    lined = pipeline.stored(pipeline.drop_lines(spark, good, SF))
    want = {i: t for i, (_, _, t) in brute_lines(kept).items()}
    assert {r.doc_id: r.text for r in lined.collect()} == want and lined.dtypes == columns

    single = pipeline.stored(pipeline.keep_first_copies(spark, lined, SF))
    groups = brute_groups(want)
    first = {i: t for i, t in want.items() if groups[i][1] == i}
    assert {r.doc_id: r.text for r in single.collect()} == first and single.dtypes == columns

    cut = pipeline.stored(pipeline.cut_repeats(spark, single, SF))
    rows = cut.collect()
    assert cut.dtypes == columns and {r.doc_id for r in rows} == set(first)
    removed = brute_cut(first)
    for r in rows:
        n, gone, _, _ = removed[r.doc_id]
        assert n - gone - 8 <= len(r.text.encode()) <= n - gone and r.n_chars == len(r.text)

    _check_packed(pipeline.pack(spark, cut, SF).collect(), {r.doc_id: r.text for r in rows})
    assert quality.THRESHOLD == 0.7 and [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "suffixes", "packing"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
    assert pipeline.pack(spark, docs, SF).count() == 0


def test_null_ids_null_texts_and_repeated_rows(spark):
    """Every stage but the first keeps such rows; only copies under another id go."""
    good = "A plain sentence of some length stands here. " * 6
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, good, "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.keep_good(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    lined = pipeline.drop_lines(spark, docs, SF).collect()
    assert len(lined) == len(rows) and {r.text for r in lined if r.doc_id == 2} == {""}
    single = pipeline.stored(pipeline.keep_first_copies(spark, docs, SF))
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "1", "3", "4", "None", "None"]
    cut = pipeline.stored(pipeline.cut_repeats(spark, docs, SF))
    assert sorted(str(r.doc_id) for r in cut.collect()) == sorted(str(r[0]) for r in rows)
    packed = pipeline.pack(spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and {r.doc_id for r in packed} == {1, 2, 3, 4, None}
