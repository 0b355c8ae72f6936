"""Chains of operators, the views over the test tables and the query catalogue."""
