import glob
import os

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from docaudit.llm import catalog
from docaudit.session import settled
from tools.check import diff

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    first = settled(corpus_pipeline.drop_rejected(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "first")
    long = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").filter("size(split(text, '[ \\n]+')) > 60").collect()}
    assert len(good & long - {r.doc_id for r in first.collect()}) <= 1
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = settled(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_registered_queries_against_sql(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, text in catalog.ORACLES.items():
        df, cur = entry.queries()[name](spark, SF), con.execute(text)
        assert not diff((df.columns, [tuple(r) for r in df.collect()]), ([x[0] for x in cur.description], cur.fetchall())), name


def test_all_eleven_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
