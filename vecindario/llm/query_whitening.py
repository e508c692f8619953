"""Query of the embedding whitening."""

from __future__ import annotations

from . import whitening

COMPONENTS = 4


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), COMPONENTS)


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
SQL: dict[str, str] = {}
