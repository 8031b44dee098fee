"""The fold as a stream: micro-batch drains, and the exact sequential cycle."""
