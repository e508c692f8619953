"""Query of the main-text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import html_text


def op1_html_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
SQL: dict[str, str] = {}
