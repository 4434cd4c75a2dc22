"""Column functions shared by operators and reports."""
