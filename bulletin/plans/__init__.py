"""All registered queries.  Importing this package registers them."""

from . import accounts, catalogue, crawl, documents, ingest, records, reports, retrieval, rules, scheduling, streams, texts, upkeep  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
