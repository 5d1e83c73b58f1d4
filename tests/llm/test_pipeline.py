from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import queries
from ledgerline.llm.common import materialize, table


def test_stages_pass_documents_on(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == names, name
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == sizes[-1]
    whole = queries.pipeline(spark, sf_dir)
    facts = [F.count(F.lit(1)), F.sum("length"), F.sum("ids_crc32"), F.countDistinct("doc_id")]
    assert whole.agg(*facts).first() == packed.agg(*facts).first()


def test_empty_tables(spark, tmp_path, nothing):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, tricky, tmp_path):
    tricky.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} >= {4, 6, 7, 8}
