import corpus_pipeline
import pytest

from tidewatch.llm import contamination, jaccard, line_dedup, registry, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        kept.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    # what was decided holds for what is left
    how = jaccard.Similarity(5, 80)
    assert jaccard.jaccard_components(docs, how).filter("doc_id <> component_id").count() == 0
    hits = contamination.contaminated_words(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert hits.filter(contamination.is_contaminated()).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == kept[-1] and set(columns) < set(last.columns)


def test_first_stages_are_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    want = toxicity.score_toxicity(docs, docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0")
    assert got == {r.doc_id for r in want.collect()}
    cut = {r.doc_id: r.kept for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()} == cut


def test_empty_and_null(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3)]
    for data, n in (([], 0), (rows, 3)):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == n


NAMES = ["op3_line_dedup", "op4_embedding_near_dedup", "op6_ngram_jaccard", "op7_url_filters", "op10_benchmark_decontamination"]


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, name):
    from check import connect, differences

    got = registry.QUERIES[name](spark, SF).toPandas()
    assert differences(got, connect(SF).execute(registry.SQL[name]).df()) == ""
