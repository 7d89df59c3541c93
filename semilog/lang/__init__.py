"""The language: syntax tree, reader, printer, JSON form and checker."""
