"""Event streams, linked faceted tables and ledger rollups as Spark plans."""
