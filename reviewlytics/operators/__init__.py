"""DataFrame operators: bounded lookups, ids, seed matching, table upkeep."""
