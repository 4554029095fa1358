"""Registered queries over the driver's tables, each with SQL to check it where SQL can express it."""

from __future__ import annotations

from . import caller, chromatograms, extras, files, formats, genes, matrices, readsets, streams, variants

MODULES = (variants, caller, readsets, matrices, genes, chromatograms, extras, formats, files, streams)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in MODULES for name, q in m.ORACLE.items()}
