"""Named checks: each is a Spark query over the driver's tables plus a DuckDB oracle."""


def load_all() -> None:
    """Import every check module so its queries register."""
    import importlib

    for mod in ("cleaning", "reports", "workflow", "texts", "states"):
        try:
            importlib.import_module(f"scrubspark.suite.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"scrubspark.suite.{mod}":
                raise
