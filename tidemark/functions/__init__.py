"""Column expressions. Nothing in here runs a job."""
