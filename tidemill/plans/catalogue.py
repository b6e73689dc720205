"""Every registered query of the curation engine, with the SQL that must give the same rows."""

from __future__ import annotations

from tidemill.plans import accounting, campaign, conversion, corpus, crawl, curation, grids, merges, reports, rules, sources, text

MODULES = (accounting, campaign, conversion, corpus, crawl, curation, grids, merges, reports, rules, sources, text)
QUERIES = {name: query for module in MODULES for name, (query, _) in module.PLANS.items()}
ORACLES = {name: sql for module in MODULES for name, (_, sql) in module.PLANS.items() if sql}
