"""Readers of feeds and configuration, and the domain tables of the jobs."""
