"""Operators for training-data pipelines of language models. Nothing outside this folder imports it."""

#: Modules with QUERIES and SQL, for the entry file.
MODULES = ["vintagraph.llm.queries"]
