"""Queries of the library and their DuckDB equivalents, by name."""

from __future__ import annotations

from pulselake.plans import clinical_queries, fhir_queries, intelligence_queries, lake_queries, ml_queries, ontology_queries, series_queries, source_queries, stream_queries, text_queries

MODULES = (lake_queries, clinical_queries, series_queries, text_queries, ml_queries, fhir_queries, intelligence_queries, ontology_queries, stream_queries, source_queries)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
