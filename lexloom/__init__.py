"""Bernoulli word vectors on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from lexloom.operators.align import align, normalize_rotation, posterior_mean, transfer_embeddings
from lexloom.operators.embedding import EmbeddingModel, contains, lookup_vectors, new_embedding, update_vectors
from lexloom.operators.graph import chain_graph, filter_edges
from lexloom.operators.holdout import holdout_accuracy, holdout_likelihood
from lexloom.operators.neighbours import (
    bilingual_lexicon_induction,
    evaluate_analogy,
    nearest_neighbors,
)
from lexloom.operators.similarity import embedding_similarities, evaluate_word_similarity
from lexloom.operators.text import preprocess_partitioned, preprocess_standard, tokenize
from lexloom.plans.map_fit import map_estimate
from lexloom.plans.vi_fit import mean_field_vi
from lexloom.sources.models import export_json, load_embedding, load_graph_embedding, load_json, save_embedding
from lexloom.streaming.partial_fit import latest_model, partial_fit_stream

# Ship the functions that run inside tasks with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "EmbeddingModel",
    "align",
    "bilingual_lexicon_induction",
    "chain_graph",
    "contains",
    "embedding_similarities",
    "evaluate_analogy",
    "evaluate_word_similarity",
    "export_json",
    "filter_edges",
    "holdout_accuracy",
    "holdout_likelihood",
    "latest_model",
    "load_embedding",
    "load_graph_embedding",
    "load_json",
    "lookup_vectors",
    "map_estimate",
    "mean_field_vi",
    "nearest_neighbors",
    "new_embedding",
    "normalize_rotation",
    "partial_fit_stream",
    "posterior_mean",
    "preprocess_partitioned",
    "preprocess_standard",
    "save_embedding",
    "tokenize",
    "transfer_embeddings",
    "update_vectors",
]
