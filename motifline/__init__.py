"""Event-pattern recognition and forecasting on Spark."""

from pathlib import Path

__version__ = "0.1.0"


def on_workers(spark):
    """Let Python workers started from another folder import this package (a cluster gets it by --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark
