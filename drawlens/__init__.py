"""Behavioural-risk analytics over draw records, expressed as Spark DataFrame plans."""
