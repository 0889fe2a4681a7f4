"""Files as Spark's own file systems see them, so that any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(self.conf)

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str | None = None) -> bool:
        return self.fs.exists(self.path(path) if path else self.at)

    def plain(self, path: str) -> str:
        """The path within its file system, decoded: the same for every way to write it."""
        return self.path(path).toUri().getPath()

    def is_folder(self) -> bool:
        return self.fs.getFileStatus(self.at).isDirectory()

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the file, or of a folder's data files in the order of their whole paths."""
        if self.fs.getFileStatus(self.at).isFile():
            return [(str(self.at.toString()), self.fs.getFileStatus(self.at).getLen())]
        found = self.fs.listFiles(self.at, True)
        out = []
        while found.hasNext():
            status = found.next()
            inner = status.getPath().toString().removeprefix(self.fs.makeQualified(self.at).toString())
            if not any(part.startswith(("_", ".")) and "=" not in part for part in inner.split("/")):
                out.append((status.getPath().toString(), status.getLen()))
        return sorted(out, key=lambda f: self.plain(f[0]))

    def tail(self, path: str, size: int, length: int) -> bytes:
        """The last ``length`` bytes of a file of ``size`` bytes."""
        return self.read(path, size - length, length)

    def read(self, path: str, start: int, length: int) -> bytes:
        stream = self.fs.open(self.path(path))
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"cannot move {source} to {target}")

    def same(self, a: str, b: str) -> bool:
        return self.fs.makeQualified(self.path(a)).equals(self.fs.makeQualified(self.path(b)))
