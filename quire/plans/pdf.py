"""Queries over PDF files made of the test documents; a round trip is its own oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from .registry import query


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tables.from_texts(spark.read.parquet(f"{d}/documents.parquet"))


def _joined(runs: DataFrame) -> DataFrame:
    pages = tables.page_text(runs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def text_roundtrip(spark, d):
    return _joined(tables.pdf_text_runs(_files(spark, d)))


@query("SELECT doc_id, CAST(ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 60.0) AS INTEGER) AS n_pages, FALSE AS repaired FROM documents")
def pdf_document_facts(spark, d):
    return tables.pdf_documents(_files(spark, d)).select(F.col("doc_id").cast("long").alias("doc_id"), "n_pages", "repaired")


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS shown FROM documents")
def pdf_operator_counts(spark, d):
    ops = tables.pdf_ops(_files(spark, d), operands=False).where("op = 'Tj'")
    return ops.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("shown"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS page_index, 595.0 AS width, 842.0 AS height FROM (SELECT doc_id, unnest(range(0, CAST(ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 60.0) AS BIGINT))) AS i FROM documents)")
def pdf_page_inheritance(spark, d):
    p = tables.pdf_pages(_files(spark, d))
    return p.select(F.col("doc_id").cast("long").alias("doc_id"), "page_index", (F.col("media_box")[2] - F.col("media_box")[0]).alias("width"), (F.col("media_box")[3] - F.col("media_box")[1]).alias("height"))


@query("SELECT doc_id, CAST(5 + 2 * ceil((length(text) - length(replace(text, chr(10), '')) + 1) / 60.0) AS BIGINT) AS n_objects, 0 AS dangling FROM documents")
def pdf_object_graph(spark, d):
    """Objects per file, and references that the object table does not resolve (an anti join)."""
    files = _files(spark, d)
    objects, refs = tables.pdf_objects(files), tables.pdf_refs(files)
    n = objects.groupBy("doc_id").agg((F.count(F.lit(1)) + 1).alias("n_objects"))
    lost = refs.join(objects.select("doc_id", F.col("obj_num").alias("dst_num")), ["doc_id", "dst_num"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lost"))
    out = n.join(lost, "doc_id", "left")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_objects", F.coalesce("lost", F.lit(0)).cast("int").alias("dangling"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:60], chr(10)) AS text FROM documents")
def pdf_extract_first_page(spark, d):
    """The first page taken out into a file of its own, which is then read again."""
    return _joined(tables.pdf_text_runs(tables.extract_pages(_files(spark, d), 0, 0)))


@query("SELECT doc_id, CAST(sum(length(line)) * 5 AS DOUBLE) AS advance FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def pdf_text_advance(spark, d):
    r = tables.pdf_text_runs(_files(spark, d))
    return r.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.sum("advance"), 3).alias("advance"))
