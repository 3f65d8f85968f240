"""End-to-end runs composed from sources, operators and sinks."""
