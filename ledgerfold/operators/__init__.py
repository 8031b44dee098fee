"""The log's operators: audit, fold, tasks, conditions, overlay, pages, apply, decisions."""
