"""tessera: document-term-author analytics as Spark DataFrame operators."""
