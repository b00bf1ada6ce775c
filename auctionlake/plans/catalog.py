"""All registered queries: name -> (callable of session and data folder, reference SQL or None)."""

from auctionlake.plans import catalog_feeds, catalog_reports, catalog_tables, catalog_text

CATALOG = {**catalog_reports.QUERIES, **catalog_text.QUERIES, **catalog_feeds.QUERIES, **catalog_tables.QUERIES}
