"""starloom: Spark jobs that turn raw sources into a layered star-schema warehouse."""
