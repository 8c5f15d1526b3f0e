"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` in
:mod:`newswell.llm.queries` registers one query per operator.
"""
