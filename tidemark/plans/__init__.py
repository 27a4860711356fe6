"""Query plans: the registry of named queries, their SQL oracles and the
end-to-end pipeline run."""
