"""Operators of a large-scale training-data pipeline (see README, section llm).

Nothing else in the library imports this subpackage; its queries are listed in
``quarry.llm.queries``.
"""
