"""Column builders; nothing in here runs a job."""
