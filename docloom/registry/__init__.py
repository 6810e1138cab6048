"""The registered queries and, for those that SQL can express, their SQL."""

from docloom.registry import evaluation, organising, search, texts

QUERIES = texts.QUERIES | search.QUERIES | organising.QUERIES | evaluation.QUERIES
ORACLES = texts.ORACLES | search.ORACLES | organising.ORACLES | evaluation.ORACLES
