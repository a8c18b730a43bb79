"""Small files on any file system that Spark reaches: the log's atomic claims, listings, reads."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or one of its own for a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    return f"{folder.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


#: Folders of local sessions that have no spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


class Files:
    """Local paths use the operating system, others Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        scheme = re.match(r"([a-z][a-z0-9+.-]*):", root)
        self.local = None if scheme and scheme[1] != "file" else re.sub(r"^file:/*", "/", self.root)

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _at(self, name: str) -> str:
        return f"{self.local if self.local is not None else self.root}/{name}"

    def list(self, folder: str) -> list[str]:
        if self.local is not None:
            return sorted(os.listdir(self._at(folder))) if os.path.isdir(self._at(folder)) else []
        fs, path = self._fs(self._at(folder))
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> bytes:
        if self.local is not None:
            with open(self._at(name), "rb") as f:
                return f.read()
        fs, path = self._fs(self._at(name))
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        if self.local is not None:
            return os.path.exists(self._at(name))
        fs, path = self._fs(self._at(name))
        return fs.exists(path)

    def size(self, path: str) -> int:
        fs, target = self._fs(path)
        return fs.getFileStatus(target).getLen()

    def modified_ms(self, name: str) -> int:
        """When anything below this name was last written to."""
        if self.local is not None:
            top = self._at(name)
            return int(1000 * max(os.path.getmtime(x) for d, _, files in os.walk(top) for x in (d, *(os.path.join(d, f) for f in files))))
        fs, path = self._fs(self._at(name))
        last, left = fs.getFileStatus(path).getModificationTime(), fs.listFiles(path, True)
        while left.hasNext():
            last = max(last, left.next().getModificationTime())
        return last

    def put_if_absent(self, name: str, data: bytes) -> bool:
        """Claim a name with its whole content, or find it taken."""
        if self.local is not None:
            os.makedirs(os.path.dirname(self._at(name)), exist_ok=True)
            draft = f"{self._at(name)}.{uuid.uuid4().hex}.tmp"
            with open(draft, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, self._at(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        return self._claim(name, data)

    def _claim(self, name: str, data: bytes) -> bool:
        """Write aside, then rename where nothing may be replaced, so that a claimed name always has its whole content.

        File systems without such a rename get a create that refuses an existing name; theirs is visible once it is closed.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, path = self._fs(self._at(name))
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)
        except Exception as e:
            if "UnsupportedFileSystem" not in str(e):
                raise
            context = None
        draft = path.suffix(f".{uuid.uuid4().hex}.tmp") if context is not None else path
        try:
            stream = fs.create(draft, False)
            stream.write(bytearray(data))
            stream.close()
            if context is not None:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, path, options)
            return True
        except Exception as e:
            if "AlreadyExists" in str(e) or fs.exists(path):
                return False
            raise
        finally:
            if context is not None:
                fs.delete(draft, False)

    def put(self, name: str, data: bytes) -> None:
        if self.local is not None:
            os.makedirs(os.path.dirname(self._at(name)), exist_ok=True)
            draft = f"{self._at(name)}.{uuid.uuid4().hex}.tmp"
            with open(draft, "wb") as f:
                f.write(data)
            os.replace(draft, self._at(name))
            return
        fs, path = self._fs(self._at(name))
        stream = fs.create(path, True)
        stream.write(bytearray(data))
        stream.close()

    def delete(self, name: str) -> None:
        fs, path = self._fs(self._at(name) if name else self.root)
        fs.delete(path, True)

    def rename(self, to: str) -> None:
        fs, path = self._fs(self.root)
        fs.rename(path, self.spark._jvm.org.apache.hadoop.fs.Path(to))
