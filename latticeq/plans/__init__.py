"""The logical query: immutable descriptions of fields, criteria, measures, tables and queries."""
