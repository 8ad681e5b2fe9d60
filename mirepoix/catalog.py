"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from mirepoix.plans import adaptation, cleaning, composites, declarations, documents, foods, graphs, matching, meals, names, nutrition, postings, questions, registry, renames, reports, rules, searches, substitutes, sync, taxonomy, texts, weights

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
