"""Making a small file exclusively: of several writers of one name one is told that it made the file.

What does that differs between file systems, and a rename that copies is none of them:

* local files: a link to a draft; renaming would replace the file;
* HDFS and others that rename at once and refuse an existing name: a draft is renamed;
* object stores: the file itself is created on the condition that there is none of its name.  It appears when
  it is complete.  S3A takes the condition as an option (Hadoop 3.4.2), which a client that does not know it refuses.

A writer may be told of a failure although its file was made (an answer that was lost and a try that was repeated).
So after any failure the file is read back: content that is the writer's own says that it was the one.  Contents
of different writers have to differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

Create = Callable[[str, bytes], bool]

RENAMED = ("hdfs", "viewfs", "abfs", "abfss")
CREATED = {"gs": None, "s3a": "fs.option.create.conditional.overwrite"}


def creator(spark: SparkSession, path: str) -> Create:
    """What makes files exclusively in the file system of ``path``; an error where that is not known to be safe."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = root.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file":
        make = _linked
    elif scheme in RENAMED:
        make = _renamed
    elif scheme in CREATED:
        make = _conditional(CREATED[scheme])
    else:
        raise ValueError(f"files of {scheme}: are not known to be made exclusively; give a function that does")
    return lambda name, content: _made(spark, make, name, content)


def read(spark: SparkSession, name: str) -> bytes | None:
    """What is in the file; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return _content(spark, fs, path) if fs.exists(path) else None


def names(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder (none if it does not exist) with the seconds of their last change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}


def _made(spark: SparkSession, make: Callable, name: str, content: bytes) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if make(spark, fs, path, content):
            return True
    except Py4JJavaError:
        if not fs.exists(path):
            raise
    return _content(spark, fs, path) == content


def _content(spark: SparkSession, fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _draft(spark: SparkSession, fs, path, content: bytes):
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".draft-{uuid.uuid4().hex}")
    _fill(fs.create(draft, False), content)
    return draft


def _fill(stream, content: bytes) -> None:
    stream.write(bytearray(content))
    stream.close()


def _linked(spark: SparkSession, fs, path, content: bytes) -> bool:
    jvm = spark._jvm
    local = lambda p: jvm.java.nio.file.Path.of(jvm.java.net.URI("file://" + p.toUri().getRawPath()))
    draft = _draft(spark, fs, path, content)
    try:
        jvm.java.nio.file.Files.createLink(local(path), local(draft))
        return True
    finally:
        fs.delete(draft, False)


def _renamed(spark: SparkSession, fs, path, content: bytes) -> bool:
    draft = _draft(spark, fs, path, content)
    if fs.rename(draft, path):
        return True
    fs.delete(draft, False)
    return False


def _conditional(option: str | None) -> Callable:
    def make(spark: SparkSession, fs, path, content: bytes) -> bool:
        builder = fs.createFile(path).overwrite(False).recursive()
        _fill((builder.must(option, "true") if option else builder).build(), content)
        return True
    return make
