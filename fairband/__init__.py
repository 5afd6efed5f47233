"""fairband: fair-value range analytics as lazy Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
small fitted-model handle) and never collects data to the driver.  Plans are
declared with the DataFrame / SQL API so Catalyst can push filters, prune
columns and choose join strategies; Structured Streaming variants live in
``fairband.streaming``.
"""

from fairband.spec import PanelSpec, default_spec

__all__ = ["PanelSpec", "default_spec"]
__version__ = "0.1.0"
