"""DataFrame operators: window extraction, counting, sorting, merging."""
