"""Queries as data, their SQL front end, the progressive loops and the service."""
