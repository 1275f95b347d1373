"""Trust-gated web evidence as Spark DataFrame operators."""
