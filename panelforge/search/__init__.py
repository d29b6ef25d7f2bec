"""Tree search for formulas: small driver-side state, with every evaluation a Spark job."""
