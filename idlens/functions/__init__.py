"""Column functions: text, secrets and the fixed catalogs."""
