"""Operators for language-model training data. Nothing outside this subpackage imports it."""

from loomrank.llm import distinctive, fusion, markup, mixing, packing, repetition, topn, tries

MODULES = [tries, distinctive, markup, topn, fusion, packing, mixing, repetition]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
