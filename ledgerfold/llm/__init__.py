"""Operators for preparing training corpora.

Nothing outside this folder imports it; `queries.py` registers one query per
operator, and the pipeline at the top of the repository composes five of them.
"""
