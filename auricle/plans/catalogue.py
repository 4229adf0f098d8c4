"""All registered queries of the library and their SQL for DuckDB."""

from __future__ import annotations

from auricle.plans import audio, cells, coded, formats, live, papers, reports, signals, spectra, streams, text

MODULES = (streams, spectra, reports, text, audio, signals, formats, coded, cells, papers, live)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
