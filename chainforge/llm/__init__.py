"""Operators that prepare large collections for training; nothing outside this package imports it."""

QUERY_MODULES = ["chainforge.llm.queries", "chainforge.llm.text_queries"]
