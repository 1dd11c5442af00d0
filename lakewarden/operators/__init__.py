"""The step algebra: pure functions from a catalog of DataFrames to a new catalog. No step runs a job,
except for the integrity checks that are asked for."""
