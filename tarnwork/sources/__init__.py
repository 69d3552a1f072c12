from tarnwork.sources.tables import table, distinct_rows  # noqa: F401
