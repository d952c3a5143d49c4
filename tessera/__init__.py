"""tessera: schema-driven parsing, validation and encoding compiled to Spark expressions."""
