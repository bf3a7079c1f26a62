"""tapewatch: market-surveillance analytics as Spark DataFrame operators."""
