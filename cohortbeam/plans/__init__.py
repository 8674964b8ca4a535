"""Query catalog: named Spark plans and their DuckDB oracle SQL."""
