"""Usage metering for language-model calls as Spark DataFrames: ingest, price, store, query, archive."""
