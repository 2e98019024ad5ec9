"""Column-level functions: seasons, classes, names, cells, dates, fingerprints."""
