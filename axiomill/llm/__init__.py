"""Operators of a training-data pipeline, and their queries (``axiomill.llm.queries``)."""
