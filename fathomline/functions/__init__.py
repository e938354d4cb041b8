"""Column expressions: windows, ranks, gates, parsing."""
