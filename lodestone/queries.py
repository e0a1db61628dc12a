"""All queries of the library outside the corpus operators; importing the modules registers them."""

from __future__ import annotations

from lodestone.functions import arrays, chemistry, composition, doping, fallback, oxidation, spectra
from lodestone.operators import aggregates, audits, frameworks, joins, metrics, neighbourhoods, projections, reports, runs, sets, windows
from lodestone.registry import ORACLE_SQL, QUERIES
from lodestone.sources import crystal, files, harvest, paged
from lodestone.streaming import stateful, telemetry

FLAGSHIP = "agg_consensus_label"
MODULES = (arrays, chemistry, composition, doping, fallback, oxidation, spectra, aggregates, audits, frameworks, joins, metrics, neighbourhoods, projections, reports, runs, sets, windows, crystal, files, harvest, paged, stateful, telemetry)
__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
