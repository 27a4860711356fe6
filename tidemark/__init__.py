"""tidemark — snapshot-history analytics expressed as Spark DataFrame operators.

Periodic full exports of an entity table are ingested idempotently, cleaned,
deduplicated, versioned (SCD Type 2) and turned into growth/churn marts and
per-entity analytics. Every operator takes and returns a lazy DataFrame, so
Catalyst plans the whole chain and nothing on a data path goes through the
driver.
"""
