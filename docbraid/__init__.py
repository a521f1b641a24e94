"""docbraid: document text pipelines expressed as Spark DataFrame transformations."""
