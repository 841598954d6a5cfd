"""reviewloom: place-review preparation expressed as Spark DataFrame plans."""
