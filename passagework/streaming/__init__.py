"""Continuous embedding jobs on Structured Streaming."""
