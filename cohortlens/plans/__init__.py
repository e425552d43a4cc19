"""Query plans built from the operators: the Community API, the thirteen analyses, the
derived analyses, registered building blocks, the registry and the DuckDB oracle SQL."""
