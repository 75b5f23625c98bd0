"""Training-data operators over the ``documents`` and ``pages`` tables.

Nothing else in the library imports this subpackage; its queries reach
``__spark_entry__`` through :mod:`sentibar.llm.registry`.
"""
