"""Small file-system steps on any Hadoop file system (driver side, names only)."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder and its file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._p("").getFileSystem(self._conf)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self._p(name)))

    def names(self, name: str = "") -> list[str]:
        """Sorted names of what lies in a folder; none if it is absent."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(name)))

    def size(self, name: str = "") -> int:
        """Bytes of all files in a folder."""
        return int(self._fs.getContentSummary(self._p(name)).getLength()) if self.exists(name) else 0

    def files(self, name: str = "") -> int:
        """Number of all files in a folder, however deep."""
        return int(self._fs.getContentSummary(self._p(name)).getFileCount()) if self.exists(name) else 0

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._p(name))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self._fs.create(self._p(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        """Move a file to another name under this folder; its parent is made."""
        self._fs.mkdirs(self._p(to).getParent())
        if not self._fs.rename(self._p(name), self._p(to)):
            raise OSError(f"{self.path}/{name} could not be moved to {to}")

    def move_new(self, name: str, to: str) -> bool:
        """Move a file to a name that must be free; False if it is taken (one atomic rename)."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._p(name), self._p(to), self._no_options())
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _no_options(self):
        from pyspark import SparkContext

        return SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def delete(self, name: str = "") -> bool:
        return bool(self._fs.delete(self._p(name), True))

    def relative(self, files: list[str]) -> list[str]:
        """Names under this folder of file URIs such as ``DataFrame.inputFiles`` gives."""
        prefix = len(str(self._fs.makeQualified(self._p("")).toUri().getPath())) + 1
        return sorted(unquote(urlparse(f).path)[prefix:] for f in files)


def glob_matches(spark: SparkSession, glob: str) -> bool:
    """Whether a path glob matches anything (one directory listing)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def input_files(df: DataFrame) -> list[str]:
    """The files that the scan of ``df`` has listed."""
    return list(df.inputFiles())
