"""The tree learner in the JVM: ``Grower.java``, compiled by Spark's own compiler and sent to the executors as a jar.

``grown`` is a Spark function of the columns of a fit's rows and a task in words; see
``Grower.call``.  The splits are those of ``trees.grow``.
Rows and columns of a round, and the rows of a bagged tree, are drawn by other random numbers.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fairband.operators import trees as T

NAME, CLASS = "fairband_grown", "fairband.Grower"


def _compiled(spark: SparkSession):
    """Loader of the classes, which the executors get as a jar from the driver's file server."""
    if getattr(spark, "_grower_classes", None) is None:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name("Grower.java").read_text())
        classes = compiler.getBytecodes()
        jar = os.path.join(tempfile.mkdtemp(), "grower.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in classes.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(classes.get(name)))
        spark.sql(f"ADD JAR '{jar}'")
        spark._grower_classes = compiler.getClassLoader()
    return spark._grower_classes


def _made(spark: SparkSession, loader, name: str):
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    return loader.loadClass(name).getDeclaredConstructor(array(jvm.Class, 0)).newInstance(array(jvm.Object, 0))


def register(spark: SparkSession) -> None:
    """Make the function known to the session."""
    if not getattr(spark, "_grower_known", False):
        one = _made(spark, _compiled(spark), CLASS)
        spark._jsparkSession.udf().register(NAME, one, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
        spark._grower_known = True


def woods(spark: SparkSession):
    """The maker of Spark ML forests, on the driver."""
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(_compiled(spark))
    compiler.cook(Path(__file__).with_name("Woods.java").read_text())
    return _made(spark, compiler.getClassLoader(), "fairband.Woods")


def grown(columns: str, task: str) -> Column:
    return F.call_function(NAME, F.col(columns), F.col(task))


def forest_task(seed: int | str, bins: int, least: float, trees, depths, output: str, first: int = 0) -> str:
    return f"forest;{seed};{bins};{least!r};{','.join(map(str, trees))};{','.join(map(str, depths))};{output};{first}"


def boosted_task(seed: int, bins: int, rounds, models: list[T.Boost], output: str) -> str:
    each = "/".join(",".join(repr(float(x)) for x in (m.depth, m.rate, m.rows, m.columns, m.least, m.l1, m.l2)) for m in models)
    return f"boosted;{seed};{bins};{','.join(map(str, rounds))};{each};{output}"

