"""The passes of `attention` in the executors' JVM: AttentionKernel.java, built on the
driver and sent as a jar.

There is no kernel where the driver's Java has no compiler or Spark runs without Java's
vector module; numpy makes the same passes there, more slowly.
"""

from __future__ import annotations

import tempfile
import warnings
import zipfile
from pathlib import Path

import numpy as np
from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession

from taskframe.llm import attention

SOURCE = Path(__file__).with_name("AttentionKernel.java")
# By application: what makes the Java functions, or None; the folder of its jar.
_makers: dict[str, JavaObject | None] = {}
_folders: list[tempfile.TemporaryDirectory] = []


class Kernel:
    """Training and scores with the tables of a corpus."""

    def __init__(self, spark: SparkSession, maker: JavaObject, tables: attention.Tables) -> None:
        parts = tables.groups, tables.classes, tables.inside, tables.group, tables.place
        self.spark, self.maker = spark, maker
        self.corpus = spark.sparkContext._jsc.broadcast(maker.corpus(*[x.astype("<f4").tobytes() for x in parts]))

    def learn(self, windows: DataFrame, schema: str, flat: np.ndarray, turn: tuple[int, int], length: int, batch: int,
              parts: int, end: int, rate: float) -> DataFrame:
        """Of the runs of windows (window, deal) a row per task: what it made of the parameters."""
        made = self.maker.learn(self.corpus, flat.astype("<f4").tobytes(), *turn, length, batch, parts, end, float(rate))
        kind = self.spark._jsparkSession.parseDataType(self.spark.createDataFrame([], schema).schema.json())
        rows = windows._jdf.mapPartitions(made, self.spark._jvm.org.apache.spark.sql.Encoders.row(kind))
        return DataFrame(rows, self.spark)

    def score(self, ids: Column, flat: np.ndarray, end: int) -> Column:
        """The log10 probability of texts, given as ids of two bytes."""
        return Column(self.maker.score(self.corpus, flat.astype("<f4").tobytes(), end, ids._jc))


def kernel(spark: SparkSession, tables: attention.Tables) -> Kernel | None:
    application = spark.sparkContext.applicationId
    if application not in _makers:
        try:
            _makers[application] = _maker(spark)
        except (Py4JError, OSError, RuntimeError) as error:
            warnings.warn(f"attention runs in numpy, which takes several times the CPU: {error}", stacklevel=2)
            _makers[application] = None
    maker = _makers[application]
    return None if maker is None else Kernel(spark, maker, tables)


def _maker(spark: SparkSession) -> JavaObject:
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    compiler = jvm.javax.tools.ToolProvider.getSystemJavaCompiler()
    if compiler is None:
        raise RuntimeError("the driver's Java has no compiler")
    _folders.append(tempfile.TemporaryDirectory(prefix="taskframe-"))
    folder = Path(_folders[-1].name).resolve()
    classes, jar = folder / "classes", folder / "attention.jar"
    classes.mkdir()
    words = ["-proc:none", "--add-modules", "jdk.incubator.vector", "-classpath",
             jvm.java.lang.System.getProperty("java.class.path"), "-d", str(classes), str(SOURCE)]
    given = gateway.new_array(jvm.java.lang.String, len(words))
    for i, word in enumerate(words):
        given[i] = word
    said = jvm.java.io.ByteArrayOutputStream()
    # Input, output, errors, words; by the interface, since the class itself is not open to callers.
    run = next(m for m in jvm.java.lang.Class.forName("javax.tools.Tool").getMethods() if m.getName() == "run")
    streams = gateway.new_array(jvm.java.lang.Object, 4)
    streams[1] = streams[2] = said
    streams[3] = given
    if run.invoke(compiler, streams):
        raise RuntimeError(said.toString())
    with zipfile.ZipFile(jar, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(classes.rglob("*.class")):
            packed.write(path, path.relative_to(classes).as_posix())
    urls = gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(str(jar)).toURI().toURL()
    loader = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    maker = loader.loadClass("taskframe.llm.AttentionKernel$Maker").newInstance()
    sizes = [attention.CONTEXT, attention.STRIDE, attention.EMBED, attention.HEAD, attention.HIDDEN, attention.GROUPS,
             attention.CLASSES, attention.WARM]
    if list(maker.sizes()) != sizes:
        raise RuntimeError("its sizes are not those of attention.py")
    spark.sparkContext._jsc.addJar(str(jar))
    return maker
