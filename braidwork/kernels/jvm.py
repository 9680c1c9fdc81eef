"""The fold compiled for the JVM, by the compiler that Spark brings for its own code.

``Fold.java`` does what ``fold``, ``align``, ``lattice`` and ``consensus`` do,
step for step, where ``supported`` says so: reads are added to an empty graph
one after another, with one consensus. It runs in the executors without a way
through Python. A session whose JVM cannot be reached (Spark Connect) or lacks
the compiler takes the numpy kernels; the results are the same.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import pkgutil
import shutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from braidwork.kernels.params import Consensus, Mode, Params

_made: dict[str, object] = {}  # the loader of the classes of each Spark application


def supported(params: Params) -> bool:
    guided = params.mode is Mode.GLOBAL and params.progressive
    return params.max_consensus == 1 and not guided and len(params.pieces) <= 2


def available(spark: SparkSession) -> bool:
    jvm = getattr(spark, "_jvm", None)
    try:
        return jvm is not None and bool(jvm.java.lang.Class.forName("org.codehaus.janino.SimpleCompiler"))
    except Exception:  # no such class
        return False


def settings(params: Params, parts: tuple[str, ...]) -> str:
    """All the kernel has to know, as one line."""
    flags = {"p": params.path_score, "r": params.gap_on_right, "e": params.gap_at_end, "s": params.both_strands, "l": params.longest_first, "q": params.use_quality, "f": params.consensus is Consensus.FREQUENT, "n": params.spanning_only, "a": params.seeding}
    flags |= {"G": "graph" in parts, "M": "msa" in parts, "C": "consensus" in parts, "A": "audit" in parts, "L": "lines" in parts}
    codes = params.encode(bytes(range(256)).decode("latin-1"))
    numbers = lambda x: ",".join(str(int(i)) for i in np.asarray(x).ravel())
    return ";".join([params.mode.value, str(params.band), repr(float(params.band_part)), str(params.zdrop), str(params.gap_extend[0]), numbers(params.pieces), "".join(f for f, x in flags.items() if x), params.letters, numbers(params.scores()), numbers(codes), str(params.k), str(params.w), str(params.min_window)])


def _kernel(spark: SparkSession, name: str):
    """An instance of a compiled class, whose jar every executor loads."""
    sc, jvm = spark.sparkContext, spark._jvm
    new = sc._gateway.new_array
    if sc.applicationId not in _made:
        source, *more = (pkgutil.get_data("braidwork.kernels", f"{x}.java").decode() for x in ("Fold", "Spell", "Vote", "Lanes"))
        first = jvm.org.codehaus.janino.SimpleCompiler()
        first.setParentClassLoader(jvm.java.lang.Class.forName("org.apache.spark.sql.Row").getClassLoader())
        first.cook(source)
        classes = dict(first.getBytecodes())
        for text in more:
            try:
                second = jvm.org.codehaus.janino.SimpleCompiler()
                second.setParentClassLoader(first.getClassLoader())
                second.cook(text)
                classes |= dict(second.getBytecodes())
            except Exception:  # a JVM without the module of vectors takes one cell at a time
                if text is not more[-1]:
                    raise
        folder = tempfile.mkdtemp(prefix="braidwork-jar-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"fold-{hashlib.sha256(''.join([source, *more]).encode()).hexdigest()[:12]}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for at, code in classes.items():
                z.writestr(at.replace(".", "/") + ".class", bytes(code))
        sc._jsc.sc().addJar(path)
        urls = new(jvm.java.net.URL, 1)
        urls[0] = jvm.java.io.File(path).toURI().toURL()
        _made[sc.applicationId] = jvm.java.net.URLClassLoader(urls, jvm.java.lang.Class.forName("org.apache.spark.sql.Row").getClassLoader())
    return _made[sc.applicationId].loadClass(f"braidwork.{name}").getDeclaredConstructor(new(jvm.java.lang.Class, 0)).newInstance(new(jvm.java.lang.Object, 0))


def call(df: DataFrame, result: str, *columns: Column, kernel: str = "Fold") -> Column:
    """A kernel on two columns; run once a row, whatever is asked of the result."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    jvm, new = sc._jvm, sc._gateway.new_array
    named = jvm.java.lang.Class.forName
    types, given = new(jvm.java.lang.Class, 2), new(jvm.java.lang.Object, 2)
    types[0], types[1] = named("org.apache.spark.sql.api.java.UDF2"), named("org.apache.spark.sql.types.DataType")
    given[0], given[1] = _kernel(spark, kernel), jvm.org.apache.spark.sql.types.DataType.fromDDL(result)
    # by reflection, since the call itself is taken for the one of untyped functions
    f = named("org.apache.spark.sql.functions").getMethod("udf", types).invoke(None, given).asNondeterministic()
    return Classic(f.apply(_to_seq(sc, columns, _to_java_column)))
