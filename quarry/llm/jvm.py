"""Steps of single bytes or bits that numpy is too slow for: Java beside this file, compiled on the driver by Spark's own
compiler (Janino, no JDK) and sent to the executors as a jar, once per application.
"""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_LOADED: dict[tuple[str, str], object] = {}


def _loader(spark: SparkSession, name: str):
    """The class loader of ``name``.java's classes; executors have them from then on."""
    key = spark.sparkContext.applicationId, name
    if key not in _LOADED:
        source = pkgutil.get_data(__package__, f"{name}.java").decode()
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        path = os.path.join(tempfile.mkdtemp(), f"quarry_{name}.jar")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for made, code in dict(compiler.getBytecodes()).items():
                z.writestr(made.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path)
        _LOADED[key] = compiler.getClassLoader()
    return _LOADED[key]


def binary(spark: SparkSession, name: str, made: str, *columns: str) -> Column:
    """What the function class ``made`` of ``name``.java gives for some columns: a binary column.

    The session gets a temporary function for it.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = _loader(spark, name).loadClass(f"quarry.{name}${made}")
    function = f"quarry_{name}_{made}"
    if not spark._jsparkSession.catalog().functionExists(function):
        one = kind.getConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(function, one, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_udf(function, *map(F.col, columns))
