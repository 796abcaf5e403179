"""Operations of a training-data pipeline: the numbered operators and their queries.

Nothing outside this subpackage imports it. ``registry.queries()`` and
``registry.oracle_sql()`` are what the repository's entry module adds.
"""
