"""Queries over the given tables, one or more per operator, with the SQL that checks them."""

from lexloom.catalog import corpus_queries, model_queries, vector_queries


def all_queries() -> dict:
    return {**corpus_queries.QUERIES, **model_queries.QUERIES, **vector_queries.QUERIES}


def all_sql() -> dict[str, str]:
    return {**corpus_queries.SQL, **model_queries.SQL, **vector_queries.SQL}
