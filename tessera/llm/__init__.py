"""Operators of a training-data pipeline, each usable on any DataFrame with an id and a text column.

Nothing outside this subpackage imports it; :mod:`tessera.llm.queries` registers its queries.
"""
