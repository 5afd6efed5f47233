"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from fairband.functions.scalar import *  # noqa: F401,F403
