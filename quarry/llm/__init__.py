"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; ``queries.py`` registers one query per operator.
"""
