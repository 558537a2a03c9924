"""Training-data operators: each module is one operator with its own general interface.

Nothing else in the library imports this subpackage.  ``queries`` holds the thin
contract queries that read a table, apply an operator and derive digest columns.
"""
