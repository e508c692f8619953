"""Query of the URL filters."""

from __future__ import annotations

from . import url_rules

# Fixed values of the contract: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = {"op5_url_filters": f"""
    WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '') AS host,
                      coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    rules(h, p, v) AS (VALUES {VALUES}),
    fits AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM (
             SELECT p.r, rules.h, rules.p, rules.v FROM p JOIN rules ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p)) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fits USING (r)"""}
QUERIES = {"op5_url_filters": op5_url_filters}
