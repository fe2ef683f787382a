"""Relational operators over triples: joins, sets, statistics, fixpoints."""
