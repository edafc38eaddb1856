"""Column-expression builders shared by the operators (and mirrored as DuckDB SQL for the oracle)."""
