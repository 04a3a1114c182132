"""DuckDB SQL that recomputes the registered queries without the engine."""
