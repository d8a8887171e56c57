"""Analytics over bank-transaction ledgers on Spark: statement ingest, dedup, recurring charges, subscription findings."""
