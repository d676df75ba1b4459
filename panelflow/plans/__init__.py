"""The four jobs, from files or tables to results."""
