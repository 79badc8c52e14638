"""The pipeline on a small folder: each stage against brute force on its own input."""

import pytest

from tests_llm_brute import line_codes, lines_left, sets_of, smallest


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    junk = spark.createDataFrame([(1000 + k, " ".join(["%%% $$$ zzz###"] * (5 + k)), "en", "s1") for k in range(25)], "doc_id long, text string, lang string, source string")
    d = docs.select("doc_id", "text", "lang", "source").unionByName(junk)
    d.selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(f"{top}/documents.parquet")
    d.selectExpr("doc_id", "cast(doc_id < 1000 as int) as quality", "0 as toxic").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, quality), (_, lines), (_, near), (_, mix), (_, pack) = cp.STAGES

    def table(df):
        return {r.doc_id: r for r in df.collect()}

    kept = quality(spark, docs, folder)
    assert kept.columns == docs.columns
    k = table(kept)
    assert len([i for i in k if i >= 1000]) <= 3 and all(i in k for i in table(docs) if i < 1000)
    cleaned = lines(spark, kept, folder)
    assert cleaned.columns == docs.columns
    own = [(i, r.text) for i, r in sorted(k.items())]
    want = lines_left(own, line_codes(spark, own))
    want = {i: t for i, t in want.items() if (t or "").split() or not (k[i].text or "").split()}
    assert {i: r.text for i, r in table(cleaned).items()} == want
    single = near(spark, cleaned, folder)
    s = sets_of([(i, t) for i, t in want.items()])
    low = smallest(s, [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]) > 0])
    assert set(table(single)) == {i for i in s if low[i] == i}
    mixed = mix(spark, single, folder)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    packed = pack(spark, mixed, folder)
    per_doc = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"ids": "count"}).withColumnRenamed("count(ids)", "n").collect()}
    assert set(per_doc) == {r.doc_id for r in mixed.collect()}


def test_run(spark, folder):
    import corpus_pipeline as cp

    out = cp.run(spark, folder)
    assert out.count() > 0 and "sequence_id" in out.columns
