"""Sources and sinks: N-Triples, encoded triples and dictionaries, relational tables."""
