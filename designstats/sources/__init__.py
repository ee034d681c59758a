from designstats.sources.tables import (
    counts_from_wide,
    literal_table,
    load_fit_table,
    lower_names,
    read_table,
    save_fit_table,
    write_report,
)

__all__ = [
    "counts_from_wide",
    "literal_table",
    "load_fit_table",
    "lower_names",
    "read_table",
    "save_fit_table",
    "write_report",
]
