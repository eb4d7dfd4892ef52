"""Sources, corpus preparation, rule packs and the scan store."""
