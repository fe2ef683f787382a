"""Scalar functions over RDF terms, IRIs, language tags and Unicode text."""
