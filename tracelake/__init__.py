"""Session-log analytics, declared as Spark DataFrame plans."""
