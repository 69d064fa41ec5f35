"""Small files and folders on any Hadoop file system, through the session's JVM."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _is(error: Py4JJavaError, *names: str) -> bool:
    """Whether the Java error or one of its causes has one of these simple class names."""
    cause = error.java_exception
    while cause is not None:
        if cause.getClass().getSimpleName() in names:
            return True
        cause = cause.getCause()
    return False


class Files:
    """File operations below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def listing(self, p: str) -> list[tuple[str, bool, int]]:
        """(name, is a folder, modification time in ms) of a folder's entries; none if it is absent."""
        try:
            found = self._fs.listStatus(self._path(p))
        except Py4JJavaError as e:
            if _is(e, "FileNotFoundException"):
                return []
            raise
        return [(x.getPath().getName(), bool(x.isDirectory()), int(x.getModificationTime())) for x in found]

    def sizes(self) -> dict[str, int]:
        """Bytes of the files right below the root, by name (percent-encoded as in a URI)."""
        found = self._fs.listStatus(self._path(self.root))
        return {x.getPath().toUri().getRawPath().rsplit("/", 1)[-1]: int(x.getLen()) for x in found if x.isFile()}

    def delete(self, p: str) -> None:
        self._fs.delete(self._path(p), True)

    def read(self, p: str) -> str | None:
        """A small text file's content, None if it is absent."""
        try:
            stream = self._fs.open(self._path(p))
        except Py4JJavaError as e:
            if _is(e, "FileNotFoundException"):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Make a file with this content, whole or not at all; False if it is there already.

        The content is written under another name, then takes its name in one
        step that fails on an existing file: a hard link on local disks, a
        rename without overwriting elsewhere (atomic on HDFS and ABFS).
        """
        draft, target = self._path(f"{p}.{uuid.uuid4().hex}.draft"), self._path(p)
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                files, file = self._jvm.java.nio.file.Files, self._jvm.java.io.File
                files.createLink(file(target.toUri().getPath()).toPath(), file(draft.toUri().getPath()).toPath())
            else:
                options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, target, options)
        except Py4JJavaError as e:
            if _is(e, "FileAlreadyExistsException"):
                return False
            raise
        finally:
            self._fs.delete(draft, False)
        return True


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame's plan reads (0 for rows held by the session)."""
    names: dict[str, set[str]] = {}
    for f in df.inputFiles():
        folder, _, name = f.rpartition("/")
        names.setdefault(folder, set()).add(name)
    total = 0
    for folder, wanted in names.items():
        sizes = Files(df.sparkSession, unquote(folder)).sizes()
        total += sum(sizes.get(n, 0) for n in wanted)
    return total
