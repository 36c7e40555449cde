"""Clone trajectories on Spark: shares of clones over time, their change, clusters and reports."""

from trajspark.plans.cleaning import clean_cells
from trajspark.plans.trajectories import Config, Trajectories, find_trajectories, without_outliers

__all__ = ["Config", "Trajectories", "clean_cells", "find_trajectories", "without_outliers"]
