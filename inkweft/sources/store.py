"""Small files of a base on whatever file system Spark reads: local, distributed or an object store."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Store:
    """Files below a root, through the file system interface that Spark's own tables use."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = str(self._jvm.org.apache.hadoop.fs.Path(root).toString())

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{name}" if name else self.root)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        """Names of the files straight in a folder."""
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []

    def make(self, name: str) -> None:
        fs, path = self._at(name)
        fs.mkdirs(path)

    def read(self, name: str) -> str | None:
        """Text of a file, None if there is none."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file and put it in place by one rename, so a reader sees the old or the new one."""
        fs, path = self._at(name)
        fs.mkdirs(path.getParent())
        tmp = self._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.new")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        self._replace(tmp, path)

    def move(self, name: str, target: str) -> None:
        """Move a file, in place of one that is there."""
        (fs, source), (_, path) = self._at(name), self._at(target)
        fs.mkdirs(path.getParent())
        self._replace(source, path)

    def _replace(self, source, path) -> None:
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = SparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else path.getFileSystem(self._conf).getUri(), self._conf).rename(source, path, how)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def above(self) -> Store | None:
        parent = self._jvm.org.apache.hadoop.fs.Path(self.root).getParent()
        if parent is None:
            return None
        out = object.__new__(Store)
        out._jvm, out._conf, out.root = self._jvm, self._conf, parent.toString()
        return out
