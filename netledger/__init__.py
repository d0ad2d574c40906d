"""netledger: access-network usage and prepaid-ledger analytics on Spark DataFrames."""
