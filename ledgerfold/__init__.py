"""Change-log analytics on Spark: fold, overlay, apply, page and audit keyed logs."""
