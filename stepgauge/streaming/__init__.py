"""Runs that take up what is new since the last one."""
