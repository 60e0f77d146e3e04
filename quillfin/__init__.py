"""quillfin: equity-research analytics expressed as Spark DataFrame operators."""
