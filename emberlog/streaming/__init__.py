"""Files that are still being written, as a stream: a tail source, and growing snapshots of a query's result."""
