"""Registry of the document-quality queries and of the SQL that each must agree with."""

from __future__ import annotations

from .plans import blocks, boilerplate, cleanup, epub, exercises, fragments, headings, lexicon, links, normalise, outline, packages, quality, references, releases, structure, titles, toc
from .streaming import jobs

FLAGSHIP = "q01_boilerplate_lines"
MODULES = (boilerplate, cleanup, lexicon, structure, blocks, headings, links, outline, packages, epub, quality, normalise, jobs, titles, toc, references, releases, fragments, exercises)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
