"""Command lines and the registered queries of the k-mer operators."""
