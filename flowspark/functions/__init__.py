"""Row functions, filters and aggregators, as column expressions."""
