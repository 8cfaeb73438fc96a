"""Tables: the fact table, dimensions, and readers and writers of text formats."""
