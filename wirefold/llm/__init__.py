"""Training-data pipeline operators.

Nothing outside this subpackage imports it.  Every operator module documents
its general interface; ``registry`` derives the contract queries from them.
"""
