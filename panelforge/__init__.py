"""Factor analytics on panel time series, expressed as Spark DataFrame plans."""
