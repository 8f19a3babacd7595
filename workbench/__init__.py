"""The supplied test tables bound to the library, the registered queries and their SQL twins."""
