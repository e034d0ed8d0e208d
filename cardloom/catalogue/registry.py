"""All registered queries."""

from functools import wraps

from cardloom.catalogue import answer_queries, card_queries, file_queries, flow_queries, retrieval_queries, student_queries, text_queries
from cardloom.session import ship_package

_GROUPS = (retrieval_queries, text_queries, card_queries, student_queries, answer_queries, flow_queries, file_queries)


def _shipped(query):
    @wraps(query)
    def run(spark, folder):
        ship_package(spark)
        return query(spark, folder)

    return run


def queries():
    return {name: _shipped(query) for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql():
    return {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}
