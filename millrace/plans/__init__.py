"""Plan-level helpers: durable intermediate tables, connected components, pipelines."""
