"""Training-data operators: ten self-contained operators and their registered queries.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of the library intact.
"""
