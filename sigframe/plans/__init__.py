"""End-to-end plans (extraction, featurisation, modelling) and the registry of
named queries with their independent SQL oracles."""
