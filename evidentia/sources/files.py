"""Small control files through Hadoop's file systems: exclusive creation,
reading, and paths that stay below a root."""

from __future__ import annotations

import posixpath
import re
import uuid

from pyspark.sql import SparkSession

_NAME_RE = re.compile(r"[A-Za-z0-9._-]{1,120}")


def contained(root: str, *parts: str) -> str:
    """``root`` and ``parts`` as a path; parts that lead out of it raise
    ValueError (absolute ones, ``..``, and those with a scheme)."""
    path = root.rstrip("/")
    for p in parts:
        if not p or "\x00" in p or "\\" in p or ":" in p or p.startswith(("/", "~")) or ".." in p.split("/"):
            raise ValueError(f"not a path below {root}: {p!r}")
        path = posixpath.join(path, posixpath.normpath(p))
    return path


def safe_name(name: str) -> str:
    """``name`` as one path segment: unchanged if it is made of letters, digits,
    dots, dashes and underscores, else its bytes in hex."""
    return name if _NAME_RE.fullmatch(name) and set(name) != {"."} else "x" + name.encode().hex()


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str | None:
        """The text of a file, None if it isn't there."""
        fs, p = self._fs(path)
        try:
            s = fs.open(p)
        except Exception as e:  # noqa: BLE001 - py4j wraps the exception
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def write(self, path: str, text: str) -> None:
        """Create or replace a file."""
        self.write_bytes(path, text.encode())

    def write_bytes(self, path: str, raw: bytes) -> None:
        fs, p = self._fs(path)
        s = fs.create(p, True)
        s.write(bytearray(raw))
        s.close()

    def create(self, path: str, text: str) -> bool:
        """Create a file with its whole content in one step; False, and nothing
        changed, if it is there already.

        A file is written beside it and given the name: by a hard link on a
        local disk, elsewhere by a rename, which must not replace (HDFS).
        """
        beside = f"{posixpath.dirname(path)}/.{uuid.uuid4().hex}"
        self.write(beside, text)
        fs, p = self._fs(path)
        q = self._fs(beside)[1]
        try:
            if fs.getScheme() != "file":
                return bool(fs.rename(q, p))
            file = lambda x: self.spark._jvm.java.io.File(x.toUri().getPath()).toPath()
            try:
                self.spark._jvm.java.nio.file.Files.createLink(file(p), file(q))
            except Exception as e:  # noqa: BLE001
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        finally:
            fs.delete(q, False)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def modified_ms(self, path: str) -> int:
        fs, p = self._fs(path)
        return int(fs.getFileStatus(p).getModificationTime()) if fs.exists(p) else 0
