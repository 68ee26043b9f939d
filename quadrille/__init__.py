"""Graph analytics on Spark: SPARQL compiled to DataFrame plans."""
