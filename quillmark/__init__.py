"""Style-change analytics on Spark: sentences, style measurements, boundaries, models and reports."""
