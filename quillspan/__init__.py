"""Text-privacy and corpus analytics expressed as Spark plans."""
