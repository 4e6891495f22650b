"""Column functions: scores, priors, patterns and detectors."""
