"""Registered queries: graph views over the tables, the operators applied to them, and SQL for the same rows."""
