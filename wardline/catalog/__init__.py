"""Registered queries with their SQL checks, run by the driver."""
