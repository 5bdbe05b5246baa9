"""Spark jobs for the data work around large speech-generation runs."""
