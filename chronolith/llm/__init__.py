"""Training-data operators: each module holds one operator and its thin query.

Nothing outside this subpackage imports it.  ``registry`` maps query names to
callables and to the SQL that checks them.
"""
