"""All queries of the engine, without those of the corpus operators."""

from memlake.plans import analytics, dedupe, evaluation, filters, graph, joins, projection, ranking, retrieval, sources, streaming

MODULES = (filters, analytics, joins, ranking, retrieval, dedupe, graph, projection, streaming, evaluation, sources)
QUERIES = {name: f for m in MODULES for name, f in m.Q.run.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.Q.sql.items()}
