"""All named queries: importing this module registers those of every plan module."""

from . import catalog, gates, logs, samples, services

QUERIES, ORACLE_SQL, FLAGSHIP = catalog.QUERIES, catalog.ORACLE_SQL, catalog.FLAGSHIP
MODULES = (catalog, samples, logs, gates, services)
