"""Tables with constraints, statements that change them, and transactions, over Parquet."""
