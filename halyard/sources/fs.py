"""Small files on whatever file system Spark reads: text in and out, replaced without a gap."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _versions(self, path: str) -> list[tuple[int, str]]:
        folder, name = path.rsplit("/", 1)
        return sorted((int(n.rsplit(".", 1)[1]), f"{folder}/{n}") for n in self.names(folder) if n.startswith(name + ".") and n.rsplit(".", 1)[1].isdigit())

    def put(self, path: str, text: str) -> None:
        """Replace the text kept under ``path``.  Versions are numbered files: a new one is written beside and takes its name by a
        rename to a name that isn't there, so at any moment ``get`` finds the old text or the new one."""
        old = self._versions(path)
        self.write_bytes(path + ".tmp", text.encode())
        self.rename(path + ".tmp", f"{path}.{old[-1][0] + 1 if old else 1}")
        for _, name in old:
            self.delete(name)

    def get(self, path: str) -> str | None:
        """The newest text put under ``path``; None if there is none."""
        found = self._versions(path)
        return self.read(found[-1][1]) if found else None

    def write_bytes(self, path: str, data: bytes) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def rename(self, path: str, to: str) -> None:
        p, fs = self._at(path)
        if not fs.rename(p, self._at(to)[0]):
            raise OSError(f"cannot rename {path} to {to}")

    def create(self, path: str, text: str) -> bool:
        """Write only if the file isn't there; the file system decides between two that try."""
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def size(self, path: str) -> int:
        p, fs = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
