"""SHA-256 of files of any size: each file is read in pieces inside one task.

No row holds a file's content: a task's JVM opens the path as Spark's readers do, through
its Hadoop file system and with the session's settings, and holds ``PIECE`` bytes of it at
a time. Spark has no function for that, so a small Java one is compiled by the compiler
that Spark's own generated code goes through (Janino) and sent to the executors.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession

PIECE = 1 << 20

_NAME = "washframe.FileSha256"
_SOURCE = """
package washframe;

public class FileSha256 implements org.apache.spark.sql.api.java.UDF1 {
    private final org.apache.spark.util.SerializableConfiguration settings;
    private final int pieceBytes;

    public FileSha256(org.apache.spark.util.SerializableConfiguration settings, int pieceBytes) {
        this.settings = settings;
        this.pieceBytes = pieceBytes;
    }

    // Not deterministic as far as Spark may know: otherwise a filter on the hash reads the files twice.
    public org.apache.spark.sql.Column of(String paths) {
        org.apache.spark.sql.Column[] column = {org.apache.spark.sql.functions.col(paths)};
        return org.apache.spark.sql.functions.udf((org.apache.spark.sql.api.java.UDF1) this,
            org.apache.spark.sql.types.DataTypes.StringType).asNondeterministic().apply(column);
    }

    public Object call(Object path) throws Exception {
        org.apache.spark.TaskContext task = org.apache.spark.TaskContext.get();
        org.apache.hadoop.fs.Path name = new org.apache.hadoop.fs.Path((String) path);
        java.security.MessageDigest found = java.security.MessageDigest.getInstance("SHA-256");
        byte[] piece = new byte[pieceBytes];
        java.io.InputStream file = name.getFileSystem(settings.value()).open(name);
        try {
            for (int n = file.read(piece); n >= 0; n = file.read(piece)) {
                if (task != null && task.isInterrupted()) {
                    throw new org.apache.spark.TaskKilledException("interrupted");
                }
                found.update(piece, 0, n);
            }
        } finally {
            file.close();
        }
        return java.util.HexFormat.of().formatHex(found.digest());
    }
}
"""


def _compiled(spark: SparkSession):
    """The Java class, in this JVM and, once per Spark application, on the executors."""
    sc = spark.sparkContext
    known = getattr(sc, "_washframe_sha256", None)
    if known and known[0] == sc.applicationId:
        return known[1]
    compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(_SOURCE)
    fd, path = tempfile.mkstemp(prefix="washframe-", suffix=".jar")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", code)
    sc._jsc.addJar(path)
    found = compiler.getClassLoader().loadClass(_NAME)
    sc._washframe_sha256 = sc.applicationId, found
    return found


def _file_sha256(spark: SparkSession, path: str) -> Column:
    sc = spark.sparkContext
    settings = spark._jsparkSession.sessionState().newHadoopConf()
    given = sc._gateway.new_array(sc._jvm.java.lang.Object, 2)
    given[0], given[1] = sc._jvm.org.apache.spark.util.SerializableConfiguration(settings), PIECE
    return Column(_compiled(spark).getConstructors()[0].newInstance(given).of(path))


def streamed_digests(paths: DataFrame) -> DataFrame:
    """(path, sha256) of files named by the column ``path``; Spark's listing, from which they
    come, deals them over tasks by size."""
    return paths.select("path", _file_sha256(paths.sparkSession, "path").alias("sha256"))
