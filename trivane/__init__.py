"""Evidence analytics on Spark: many noisy, three-valued measurements, aggregated with explicit denominators."""
