"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries()`` and
``oracle_sql()`` in :mod:`quernstone.llm.registry` are what the driver entry
module picks up when the subpackage is present.
"""
