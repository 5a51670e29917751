"""scrubspark: table cleaning and data-quality reports as Spark DataFrame transforms.

    from scrubspark import cells, rows, reports, correlation, history, run_recipe, VersionedTable
"""

from scrubspark.operators import cells, correlation, history, reports, rows
from scrubspark.plans.recipe import run_recipe
from scrubspark.plans.versions import VersionedTable, replay_version_log

__version__ = "0.1.0"

__all__ = ["cells", "correlation", "history", "reports", "rows", "run_recipe", "VersionedTable",
           "replay_version_log"]
