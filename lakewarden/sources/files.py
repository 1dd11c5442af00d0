"""Files by path or URI through Spark's file systems, so that what the driver reads, writes, lists and moves may lie in
any store that Spark reaches."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import SparkSession

CHUNK = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: in ``spark.checkpoint.dir``, else in the warehouse; a local session has a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="lakewarden-core-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """The file systems of a session. Paths without a scheme belong to the session's default one."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        place = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return place.getFileSystem(self._conf), place

    def exists(self, path: str) -> bool:
        store, place = self._at(path)
        return store.exists(place)

    def size(self, path: str) -> int:
        store, place = self._at(path)
        return store.getContentSummary(place).getLength()

    def files(self, folder: str) -> list[str]:
        """The files (not folders) in a folder, in order of their names, as full paths."""
        store, place = self._at(folder)
        found = [s.getPath() for s in store.listStatus(place) if s.isFile()]
        return [f"{str(folder).rstrip('/')}/{p.getName()}" for p in sorted(found, key=lambda p: p.getName())]

    def head(self, path: str, size: int) -> bytes:
        """The first bytes of a file, or of the first data file of a folder that has any (a task without rows may leave an empty one)."""
        store, place = self._at(path)
        if store.getFileStatus(place).isDirectory():
            listed = [s for s in store.listStatus(place) if s.isFile() and s.getLen() and not s.getPath().getName().startswith(("_", "."))]
            if not listed:
                return b""
            place = min((s.getPath() for s in listed), key=lambda p: p.getName())
        stream = store.open(place)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        """A small file: a document, a sidecar."""
        store, place = self._at(path)
        stream = store.open(place)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8-sig")
        finally:
            stream.close()

    def input(self, path: str) -> Any:
        """A Java stream over a file; the caller closes it."""
        store, place = self._at(path)
        return store.open(place)

    def output(self, path: str) -> io.BufferedWriter:
        """A new file, written in large chunks; folders above it are made."""
        store, place = self._at(path)
        return io.BufferedWriter(_Output(store.create(place, True)), CHUNK)

    def append(self, path: str, out: io.BufferedWriter) -> None:
        """The bytes of a file to one of :meth:`output`, a buffer at a time and none of them through Python."""
        out.flush()
        size, stream = self.size(path), self.input(path)
        try:
            out.raw.copy(self._jvm, stream, size)
        finally:
            stream.close()

    def make(self, folder: str) -> None:
        store, place = self._at(folder)
        store.mkdirs(place)

    def delete(self, folder: str) -> None:
        """A folder and what is in it."""
        store, place = self._at(folder)
        store.delete(place, True)

    def write_text(self, path: str, text: str) -> None:
        with self.output(path) as out:
            out.write(text.encode())

    def create_new(self, path: str, text: str) -> bool:
        """A small file that appears whole, unless there is one of its name already (False). Of writers side by side one
        succeeds, on local disks and on stores whose rename is atomic and replaces nothing."""
        store, place = self._at(path)
        draft = f"{str(path).rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        self.write_text(draft, text)
        source = self._jvm.org.apache.hadoop.fs.Path(draft)
        try:
            if store.getUri().getScheme() != "file":
                return not store.exists(place) and store.rename(source, place)
            link = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self._jvm.java.nio.file.Files.createLink(link(place), link(source))
            except Exception as error:
                if "FileAlreadyExistsException" in str(error):
                    return False
                raise
            return True
        finally:
            store.delete(source, False)

    def move(self, path: str, folder: str) -> str:
        """Move a file into a folder of the same store, or copy and delete it where the stores differ."""
        store, place = self._at(path)
        other, target = self._at(f"{str(folder).rstrip('/')}/{name_of(path)}")
        other.mkdirs(target.getParent())
        moved = self._jvm.org.apache.hadoop.fs.FileUtil.copy(store, place, other, target, True, True, self._conf) if store.getUri() != other.getUri() else store.rename(place, target)
        if not moved:
            raise OSError(f"can't move {path} to {folder}")
        return str(target)


class _Output(io.RawIOBase):
    """A Java output stream as a Python one; it can't seek."""

    def __init__(self, stream: Any):
        self._stream, self._at = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        self._stream.write(bytes(data))
        self._at += len(data)
        return len(data)

    def copy(self, jvm: Any, source: Any, size: int) -> None:
        """All bytes of a Java input stream, which are ``size``."""
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, self._stream, CHUNK, False)
        self._at += size

    def tell(self) -> int:
        return self._at

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def name_of(path: str) -> str:
    return str(path).rstrip("/").rsplit("/", 1)[-1]


def stem_of(path: str) -> str:
    """The name without its last extension."""
    name = name_of(path)
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def extension_of(path: str) -> str:
    """The last extension in lower case, with its dot; empty where there is none."""
    name = name_of(path)
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
