"""Registered queries with the SQL each one must agree with."""

from . import annotations, runs, scoring, selection, shards, sinks, tokens

REGISTERED = (annotations, selection, tokens, scoring, runs, sinks, shards)
