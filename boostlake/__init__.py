"""boostlake: gradient boosting and data preparation as Spark DataFrame plans."""
