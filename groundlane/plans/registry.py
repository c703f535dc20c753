"""All queries over the reference's operators and their SQL."""

from . import curation, files, geometry, prompts, training

QUERIES = {k: v for m in (curation, prompts, geometry, training, files) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (curation, prompts, geometry, training, files) for k, v in m.SQL.items()}
