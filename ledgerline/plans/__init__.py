"""Registered queries and their SQL."""

from ledgerline.plans import change_queries, gate_queries, nested_queries, read_queries, table_queries, text_queries

ALL = text_queries.QUERIES | table_queries.QUERIES | change_queries.QUERIES | gate_queries.QUERIES | nested_queries.QUERIES | read_queries.QUERIES


def queries():
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
