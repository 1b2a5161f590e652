"""Writers: datasets, prediction stores, reports, run metadata."""
