"""All queries over the driver tables and the SQL that must give the same rows."""

from . import catalogue, context, contracts, documents, evaluation, indexes, requests, retrieval, scores, stored, streams, tasks

QUERIES = {**documents.QUERIES, **catalogue.QUERIES, **retrieval.QUERIES, **evaluation.QUERIES, **contracts.QUERIES, **scores.QUERIES, **tasks.QUERIES, **streams.QUERIES, **stored.QUERIES, **indexes.QUERIES, **context.QUERIES, **requests.QUERIES}
ORACLES = {**documents.ORACLES, **catalogue.ORACLES, **retrieval.ORACLES, **evaluation.ORACLES, **contracts.ORACLES, **scores.ORACLES, **tasks.ORACLES, **streams.ORACLES, **stored.ORACLES, **indexes.ORACLES, **context.ORACLES, **requests.ORACLES}
