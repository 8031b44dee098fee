"""Column functions: conditions and their messages, codec checks, cursors."""
