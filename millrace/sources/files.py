"""Files through Hadoop's own interface, so any store that Spark reads will do."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


class Files:
    """Small files and folders by path."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm  # noqa: SLF001
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def make_folder(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new))

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a whole file under another name, then rename it into place."""
        fs, p = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"cannot write {path}")

    def stats(self, path: str) -> list[tuple[str, int, int]]:
        """(name, size, time) of all files below a path, hidden ones left out."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out = []
        it = fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            name = s.getPath().toString()
            if not any(part.startswith(("_", ".")) for part in name.rsplit("/", 3)[-2:]):
                out.append((name, int(s.getLen()), int(s.getModificationTime())))
        return sorted(out)
