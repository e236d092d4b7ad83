"""Vesperline: task, schedule and agenda jobs on Spark DataFrames."""
