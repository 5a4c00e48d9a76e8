"""Operations of a training-data pipeline: cleaning, deduplication, scoring, mixing and token output.

Nothing else in the library imports this subpackage; ``llm.queries`` lists its queries and their SQL.
"""
