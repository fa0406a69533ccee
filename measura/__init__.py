"""measura: exact pattern analytics, expressed as Spark plans."""
