"""helixmill: Spark jobs for describing, scoring and designing short regulatory DNA sequences."""
