"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, but for ``common.stage``.  Each module holds one operator with a
general interface; :mod:`pagewright.llm.queries` derives the registered ``opN_<name>`` queries.
"""
