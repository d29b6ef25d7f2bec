"""From formulas to plans."""
