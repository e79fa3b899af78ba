"""File operations on any file system Hadoop knows, from the driver."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import SparkSession


def s3_options(url: str) -> dict[str, str]:
    """Hadoop settings of an object store URL, s3://key:secret@host/bucket/path?secure=&region=.

    They are for a session's configuration; nothing here logs or stores them."""
    from urllib.parse import parse_qs, unquote, urlsplit

    u = urlsplit(url)
    if u.scheme not in ("s3", "s3a") or not u.hostname:
        raise ValueError("no s3:// URL")
    options = {k: v[-1] for k, v in parse_qs(u.query).items()}
    out = {"fs.s3a.endpoint": u.hostname + (f":{u.port}" if u.port else ""), "fs.s3a.path.style.access": "true", "fs.s3a.connection.ssl.enabled": str(options.get("secure", "true") != "false").lower()}
    if u.username:
        out |= {"fs.s3a.access.key": unquote(u.username), "fs.s3a.secret.key": unquote(u.password or "")}
    if "region" in options:
        out["fs.s3a.endpoint.region"] = options["region"]
    return out


def s3_location(url: str) -> str:
    """The s3a:// location that an object store URL names."""
    from urllib.parse import urlsplit

    return "s3a://" + urlsplit(url).path.strip("/")


class Files:
    """Hadoop's file systems; paths of the local one are handled without a detour through the JVM."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._local_by_default = self._conf.get("fs.defaultFS", "file:///").startswith("file:")

    def _here(self, path: str) -> str | None:
        """The path on this machine, or None for another file system's."""
        if path.startswith("file:"):
            return "/" + path.removeprefix("file:").lstrip("/")
        return path if self._local_by_default and "://" not in path else None

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        if (here := self._here(path)) is not None:
            return os.path.exists(here)
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[tuple[str, bool, int]]:
        """[(name, is a directory, bytes)] of a directory, in order of name; none if it is missing."""
        if (here := self._here(path)) is not None:
            out = []
            try:
                for e in os.scandir(here):
                    try:
                        out.append((e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size))
                    except FileNotFoundError:
                        pass  # renamed or deleted meanwhile
            except (FileNotFoundError, NotADirectoryError):
                pass
            return sorted(out)
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p))

    def walk(self, path: str) -> list[tuple[str, int]]:
        """[(path below `path`, bytes)] of all files."""
        out = []
        for name, is_dir, size in self.list(path):
            out += [(f"{name}/{sub}", n) for sub, n in self.walk(f"{path}/{name}")] if is_dir else [(name, size)]
        return out

    def mkdirs(self, path: str) -> None:
        if (here := self._here(path)) is not None:
            os.makedirs(here, exist_ok=True)
            return
        fs, p = self._at(path)
        fs.mkdirs(p)

    def move(self, source: str, target: str) -> None:
        """Rename, replacing the target."""
        here, there = self._here(source), self._here(target)
        if here is not None and there is not None:
            os.makedirs(os.path.dirname(there), exist_ok=True)
            os.replace(here, there)
            return
        fs, p = self._at(source)
        q = self._jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(q.getParent())
        if fs.exists(q):
            fs.delete(q, False)
        if not fs.rename(p, q):
            raise OSError(f"{source} can't be moved to {target}")

    def duplicate(self, source: str, target: str) -> None:
        """A second name for a file: a hard link where there are any, else a copy."""
        here, there = self._here(source), self._here(target)
        if here is not None and there is not None:
            os.link(here, there)
            return
        fs, p = self._at(source)
        other, q = self._at(target)
        if not self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, self._conf):
            raise OSError(f"{source} can't be copied to {target}")

    def create_new(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False if another writer was first. Readers see it whole."""
        if (here := self._here(path)) is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            part = f"{here}.{uuid.uuid4().hex}.tmp"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, here)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(part)
        from py4j.protocol import Py4JJavaError

        fs, p = self._at(path)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.toString():
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def delete(self, path: str, recursive: bool = False) -> None:
        if (here := self._here(path)) is not None:
            if os.path.isdir(here) and recursive:
                shutil.rmtree(here, ignore_errors=True)
            elif os.path.exists(here):
                os.remove(here)
            return
        fs, p = self._at(path)
        fs.delete(p, recursive)

    def read_text(self, path: str) -> str:
        if (here := self._here(path)) is not None:
            with open(here, encoding="utf-8") as f:
                return f.read()
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Written beside and renamed, so readers see the old or the new text."""
        if (here := self._here(path)) is not None:
            os.makedirs(os.path.dirname(here), exist_ok=True)
            part = f"{here}.{uuid.uuid4().hex}.tmp"
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, here)
            return
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, p = self._at(part)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self.move(part, path)
