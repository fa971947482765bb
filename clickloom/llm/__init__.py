"""Operators for preparing training data: rules, scoring, packing, tokenisation, near copies, archives.

Nothing outside this folder imports it; ``queries.py`` registers one query for each operator.
"""
