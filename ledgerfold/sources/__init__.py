"""Where logs come from and go to: views over tables, a Parquet log, a generator."""
