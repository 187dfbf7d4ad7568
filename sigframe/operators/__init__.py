"""DataFrame operators, grouped by family (catalogue, series, regions, features,
selection, matrix, models, metrics).  Every function takes and returns
DataFrames and never collects data to the driver."""
