"""Training-data operators: one module per operator, registered in `queries.py`.

Nothing outside this subpackage imports it.
"""
