"""Projections of the word × term matrix: ``project(centroids, dim) -> (word, vec)``."""

from .discriminant import discriminant_vectors
from .graph import graph_model, graph_vectors, knn_graph, spectral_coordinates
from .kmeans import kmeans_vectors, minibatch_vectors
from .nmf import nmf_vectors
from .random import random_vectors
from .summaries import summary_vectors
from .svd import svd_vectors
from .tangent import tangent_model, tangent_vectors
from .topics import topic_vectors

__all__ = [
    "discriminant_vectors", "graph_model", "graph_vectors", "kmeans_vectors", "knn_graph", "minibatch_vectors", "nmf_vectors",
    "random_vectors", "spectral_coordinates", "summary_vectors", "svd_vectors", "tangent_model", "tangent_vectors",
    "topic_vectors",
]
