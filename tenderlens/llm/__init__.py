"""Training-data operators: ten numbered operators over ``documents`` and their queries.

Nothing outside this subpackage imports it.  ``queries.QUERIES`` and ``queries.ORACLE``
hold what the entry module registers.
"""
