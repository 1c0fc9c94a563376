"""Java classes beside the operators: compiled by the compiler that Spark brings, and sent to executors as a jar."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import zipfile
from importlib import resources

from pyspark.sql import DataFrame, SparkSession

#: Loaded classes by application and source.
_loaded: dict = {}


def load(spark: SparkSession, name: str, *args):
    """An object of millrace.<name>, whose source lies beside this module, in the driver. Executors can read it from then on."""
    sc = spark.sparkContext
    source = resources.files(__package__).joinpath(f"{name}.java").read_text()
    key = sc.applicationId, hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        where = tempfile.mkdtemp(prefix="millrace-jar-")  # executors that come later fetch it from the driver
        atexit.register(shutil.rmtree, where, True)
        jar, made = f"{where}/millrace-{name}-{key[1][:16]}.jar", compiler.getBytecodes()
        with zipfile.ZipFile(jar, "w") as out:
            for entry in made.keySet():
                out.writestr(entry.replace(".", "/") + ".class", bytes(made.get(entry)))
        sc._jsc.addJar(jar)
        _loaded[key] = compiler.getClassLoader().loadClass(f"millrace.{name}")
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
    for i, x in enumerate(args):
        values[i] = x
    return _loaded[key].getConstructors()[0].newInstance(values)


def map_partitions(df: DataFrame, function, schema: str) -> DataFrame:
    """df's partitions through a MapPartitionsFunction of rows."""
    spark = df.sparkSession
    kind = spark.createDataFrame([], schema).schema
    encoder = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(spark._jsparkSession.parseDataType(kind.json()))
    return DataFrame(df._jdf.mapPartitions(function, encoder), spark)
