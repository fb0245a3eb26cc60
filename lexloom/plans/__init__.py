"""Registered queries of the library: ``QUERIES`` and their SQL in ``ORACLES``."""

from lexloom.plans import annotation, linkage, more, references, scopes, search, segmentation, store, vectors

QUERIES = {}
ORACLES = {}
for module in (segmentation, search, store, vectors, annotation, more, references, scopes, linkage):
    QUERIES |= module.R.queries
    ORACLES |= module.R.oracles
