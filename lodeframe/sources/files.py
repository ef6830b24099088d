"""Small files on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._sc, self.root = spark.sparkContext, root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._sc._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; false if there is one, which only one of several writers can avoid."""
        try:
            stream = self._fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes a file so that readers see the old one or the new one."""
        self._fs.delete(self._path(f".{name}.new"), False)
        self.create(f".{name}.new", text)
        jvm = self._sc._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._sc._jsc.hadoopConfiguration())
        context.rename(self._path(f".{name}.new"), self._path(name), options)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, names: list[str]) -> int:
        """Bytes under some folders."""
        return sum(self._fs.getContentSummary(self._path(n)).getLength() for n in names)

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []
