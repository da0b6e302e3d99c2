"""Spark jobs over the event log, job table and workflow tables of a background-job system."""
