"""Plan helpers (materialised tables, checked broadcasts) and the query catalogue."""
