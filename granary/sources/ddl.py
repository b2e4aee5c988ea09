"""Statements for stores outside Spark that hold what is computed here: tables of vectors with their indexes, tables of cells."""

from __future__ import annotations

import re


#: Cells and tables as Spark tables.
TABLES = "table_id string, doc_id long, rows int, cols int"
CELLS = "table_id string, row int, col int, value string"


def _name(table: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(f"not a table name: {table!r}")
    return table


def create_vectors(table: str, dim: int) -> str:
    return f"CREATE TABLE IF NOT EXISTS {_name(table)} (doc_id TEXT PRIMARY KEY, embedding VECTOR({int(dim)}), metadata JSONB)"


def create_graph_index(table: str, links: int = 16, width: int = 64, measure: str = "vector_cosine_ops") -> str:
    return f"CREATE INDEX IF NOT EXISTS {_name(table)}_graph ON {_name(table)} USING hnsw (embedding {_name(measure)}) WITH (m = {int(links)}, ef_construction = {int(width)})"


def set_search_width(width: int) -> str:
    return f"SET hnsw.ef_search = {int(width)}"


def add_code_column(table: str, dim: int) -> str:
    return f"ALTER TABLE {_name(table)} ADD COLUMN IF NOT EXISTS code BIT({int(dim)})"


def nearest(table: str, k: int, condition: str | None = None) -> str:
    where = f" WHERE {condition}" if condition else ""
    return f"SELECT doc_id FROM {_name(table)}{where} ORDER BY embedding <=> %(query)s LIMIT {int(k)}"


def nearest_then_filter(table: str, k: int, condition: str) -> str:
    return f"SELECT doc_id FROM (SELECT * FROM {_name(table)} ORDER BY embedding <=> %(query)s LIMIT {int(k)}) t WHERE {condition}"


def rescored(table: str, pool: int, k: int) -> str:
    return f"SELECT doc_id FROM (SELECT * FROM {_name(table)} ORDER BY code <~> %(code)s LIMIT {int(pool)}) t ORDER BY embedding <=> %(query)s LIMIT {int(k)}"
