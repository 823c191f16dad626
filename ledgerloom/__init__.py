"""ledgerloom: analytics for UTXO ledgers, declared as Spark DataFrames."""
