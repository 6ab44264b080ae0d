"""Operators that prepare text for language-model training.

Nothing outside this folder imports it. Every operator takes DataFrames and
returns DataFrames; :mod:`deltaloom.llm.queries` binds them to the tables.
"""
