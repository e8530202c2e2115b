"""sessionscope: multi-tenant clickstream sales analytics on Spark DataFrames.

Layout
------
sources/    fixture derivation, nested-event flattening, master-data cleaning, sinks
functions/  column-level helpers (key/value lookup, time buckets, labels, JSON)
operators/  reusable relational building blocks (identity join, paging, session sets)
plans/      the analytic queries, report roll-ups and priority rules
streaming/  incremental re-ingest and streaming time buckets
"""

from sessionscope.session import build_session, ensure_checkpoint_dir
from sessionscope.sources.fixtures import Tables, load_tables

__all__ = ["Tables", "build_session", "ensure_checkpoint_dir", "load_tables"]
