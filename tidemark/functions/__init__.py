"""Column expressions shared by the jobs. No Python runs per row."""
