"""All registered queries and their SQL."""

from __future__ import annotations

from tickweave.plans import execution, features, fills, labels, live, models, more, problems, research

MODULES = (problems, features, labels, fills, execution, models, more, live, research)
FLAGSHIP = "ic_daily"
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
