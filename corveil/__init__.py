"""corveil: reward, curation and evaluation analytics as Spark DataFrame plans."""
