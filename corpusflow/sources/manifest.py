"""One manifest per store: which folder holds the current rows of each corpus.

A manifest is a numbered JSON file; its successor is committed by renaming a finished file to
the next number, which fails if another writer was there first (the way Structured Streaming
commits its logs). The loser reads the new manifest and tries again, so writers of different
corpora all get through, and of two writers of one corpus the one whose input is out of date
learns it (:class:`Conflict`). Reading costs one listing and one small file, O(corpora).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Numbered files that stay behind the newest, for readers that have just listed them.
KEPT = 3


class Conflict(Exception):
    """Another writer has replaced corpora since they were read."""

    def __init__(self, corpora: Iterable[str]):
        self.corpora = sorted(corpora)
        super().__init__(f"replaced since they were read: {', '.join(self.corpora)}")


class Manifest:
    """``entries``: corpus to folder; ``marks``: the last number of each marked series; ``old``: folders
    that were replaced and not yet deleted."""

    def __init__(self, number: int = 0, entries: dict[str, str] | None = None, marks: dict[str, int] | None = None, old: list[str] | None = None):
        self.number, self.entries, self.marks, self.old = number, entries or {}, marks or {}, old or []

    def has(self, mark: str) -> bool:
        """Whether ``mark`` was committed. Marks ``<series>-<number>`` are committed in order, so one number a series is kept."""
        series, number = _series(mark)
        return self.marks.get(series, -1) >= number


def _series(mark: str) -> tuple[str, int]:
    series, _, number = mark.rpartition("-")
    return (series, int(number)) if series and number.isdigit() else (mark, 0)


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_manifests")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, folder, folder.getFileSystem(conf), conf


def _numbers(folder, fs) -> list[int]:
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())


def read(spark: SparkSession, root: str) -> Manifest:
    jvm, folder, fs, _ = _files(spark, root)
    numbers = _numbers(folder, fs)
    if not numbers:
        return Manifest()
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, str(numbers[-1])))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    return Manifest(numbers[-1], found["entries"], found["marks"], found["old"])


def _try_commit(spark: SparkSession, root: str, new: Manifest) -> bool:
    number = new.number
    jvm, folder, fs, conf = _files(spark, root)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{number}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps({"entries": new.entries, "marks": new.marks, "old": new.old}, sort_keys=True).encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(folder, str(number)), options)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(draft, False)
        return False
    for old in _numbers(folder, fs)[:-KEPT]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder, str(old)), False)
    return True


def commit(spark: SparkSession, root: str, changes: dict[str, str | None], seen: Manifest, mark: str | None = None) -> Manifest:
    """Set the folders of ``changes`` (None: the corpus is gone). ``seen``: the manifest that the
    writer's input came from. Raises :class:`Conflict` if one of these corpora, or the mark, was
    committed by somebody else since; commits for other corpora only cause another try."""
    while True:
        now = read(spark, root)
        lost = [c for c in changes if now.entries.get(c) != seen.entries.get(c)]
        if lost or (mark is not None and now.has(mark)):
            raise Conflict(lost or [mark])
        entries = {c: f for c, f in {**now.entries, **changes}.items() if f is not None}
        old = sorted({*now.old, *(set(now.entries.values()) - set(entries.values()))})
        marks = now.marks if mark is None else {**now.marks, _series(mark)[0]: _series(mark)[1]}
        new = Manifest(now.number + 1, entries, marks, old)
        if _try_commit(spark, root, new):
            return new


def forget(spark: SparkSession, root: str, folders: Iterable[str]) -> None:
    """Take deleted folders off the list of old ones."""
    folders = set(folders)
    while folders:
        now = read(spark, root)
        if _try_commit(spark, root, Manifest(now.number + 1, now.entries, now.marks, [f for f in now.old if f not in folders])):
            return
