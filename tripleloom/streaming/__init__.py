"""Incremental maintenance of a closure over a stream of triples."""
