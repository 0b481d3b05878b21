"""Column-level helpers: fixed catalogues, regex dialect, text functions."""
