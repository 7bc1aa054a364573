"""The queries of this package and their SQL."""

from __future__ import annotations

from tesela.llm import audio, fill_middle, fingerprints, html_extract, jaccard_join, language, line_dedup, mixing, packing, phrases, sharding, simhash, warc

MODULES = [packing, line_dedup, sharding, jaccard_join, mixing, html_extract, fingerprints, warc, language, audio, simhash, phrases, fill_middle]
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
