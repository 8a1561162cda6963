"""quillspark: document intelligence and training-data operators as Spark DataFrame jobs."""
