"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator module
holds a general operator; ``queries`` holds the thin queries and their SQL.
"""
