"""Operators for preparing large language-model corpora, and the queries that apply them."""
