"""Releases: one numbered manifest names one version of every table of a warehouse.

Layout below a warehouse root (any Hadoop file system)::

    <root>/<schema>/<name>/v=<version>/part-*.parquet
    <root>/_releases/<number>.json     {"tables": {"schema.name": {version, rows, schema}}}

The live release is the manifest with the highest number.  A writer stages new
versions, checks them through ``Release.read``, and commits by creating the next
number's file, which fails if another writer was first (compare and set).  Then
the changes are carried over onto that release, unless it changed a table that
this writer read or wrote: the commit raises ``ReleaseConflict`` and the staged
folders go.  Readers resolve one manifest, so they never see versions of
different releases; a run that fails before its commit changes nothing.

Row counts come from ``DataFrame.observe`` on the write.  With the schema they
stay in the manifest, so counts, emptiness and readiness of published tables
need no scan.  Nothing is removed by writing: ``vacuum`` is a call of its own.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.sinks.files import Files

LOG = "_releases"
#: Commits tried while other writers keep coming first.
ATTEMPTS = 100
# Fixed value: the rule for schema, table and column names.
IDENTIFIER = r"[a-z_][a-z0-9_]*"
_TABLE = re.compile(rf"(?P<schema>{IDENTIFIER})\.(?P<name>{IDENTIFIER})", re.IGNORECASE)


class ReleaseConflict(RuntimeError):
    """Another writer committed a change to a table that this release read or wrote."""


def table_folder(root: str, table: str) -> str:
    """Folder of a ``schema.name``; any other kind of name is refused."""
    found = _TABLE.fullmatch(table)
    if found is None or found["schema"] == LOG:
        raise ValueError(f"{table!r} is not a schema.name of plain identifiers")
    return f"{root.rstrip('/')}/{found['schema']}/{found['name']}"


@dataclass(frozen=True)
class TableVersion:
    """One written version of a table: its folder's name, rows and schema (JSON)."""

    version: str
    rows: int
    schema: str

    def path(self, root: str, table: str) -> str:
        return f"{table_folder(root, table)}/v={self.version}"

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def frame(self, spark: SparkSession, root: str, table: str) -> DataFrame:
        return spark.read.schema(self.struct()).parquet(self.path(root, table))


@dataclass(frozen=True)
class Manifest(Mapping[str, TableVersion]):
    """The tables of one release (number 0: an empty warehouse)."""

    number: int = 0
    tables: dict[str, TableVersion] = field(default_factory=dict)

    def __getitem__(self, table: str) -> TableVersion:
        return self.tables[table]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def _manifest_numbers(files: Files) -> list[int]:
    names = (name for name, _, _ in files.listing(f"{files.root}/{LOG}"))
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{20}\.json", n))


def _manifest_path(root: str, number: int) -> str:
    return f"{root}/{LOG}/{number:020d}.json"


def live_manifest(spark: SparkSession, root: str, files: Files | None = None) -> Manifest:
    """The manifest with the highest number."""
    files = files or Files(spark, root)
    while numbers := _manifest_numbers(files):
        text = files.read(_manifest_path(files.root, numbers[-1]))
        if text is not None:  # None: a vacuum came between, there is a newer one
            tables = {t: TableVersion(**v) for t, v in json.loads(text)["tables"].items()}
            return Manifest(numbers[-1], tables)
    return Manifest()


class Warehouse(Mapping[str, DataFrame]):
    """All tables of one release, whatever is committed meanwhile."""

    def __init__(self, spark: SparkSession, root: str, manifest: Manifest | None = None):
        self.spark, self.root = spark, root
        self.manifest = live_manifest(spark, root) if manifest is None else manifest

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.manifest:
            raise KeyError(table)
        return self.manifest[table].frame(self.spark, self.root, table)

    def __iter__(self) -> Iterator[str]:
        return iter(self.manifest)

    def __len__(self) -> int:
        return len(self.manifest)


class Release:
    """A writer's staged changes on top of the release it started from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._files = Files(spark, root)
        self.base = live_manifest(spark, root, self._files)
        self.staged: dict[str, TableVersion] = {}
        self._folders: list[str] = []
        self._used: set[str] = set()

    def __enter__(self) -> Release:
        return self

    def __exit__(self, kind: object, value: object, trace: object) -> None:
        self.abandon()  # what was committed is no longer staged

    def write(self, df: DataFrame, table: str, *, sort_within: list[str] | None = None) -> int:
        """Write a new version that only this release sees; its rows."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        folder = f"{table_folder(self.root, table)}/v={version}"
        self._folders.append(folder)
        self._used.add(table)
        seen = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if sort_within:
            out = out.sortWithinPartitions(*sort_within)
        out.write.mode("errorifexists").parquet(folder)
        rows = int(seen.get["rows"])
        self.staged[table] = TableVersion(version, rows, _nullable(df.schema).json())
        return rows

    def read(self, table: str) -> DataFrame:
        """The version staged here, else the one of the release this one started from."""
        self._used.add(table)
        found = self.staged.get(table) or self.base.get(table)
        if found is None:
            raise FileNotFoundError(f"table {table} has no published version under {self.root}")
        return found.frame(self.spark, self.root, table)

    def commit(self) -> Manifest:
        """Make the staged versions live together; ``ReleaseConflict`` if another writer was first."""
        live = self.base
        for _ in range(ATTEMPTS):
            changed = sorted(t for t in self._used if live.get(t) != self.base.get(t))
            if changed:
                self.abandon()
                raise ReleaseConflict(f"release {live.number} changed {', '.join(changed)} after release {self.base.number}")
            new = Manifest(live.number + 1, {**live.tables, **self.staged})
            text = json.dumps({"tables": {t: asdict(v) for t, v in new.items()}}, sort_keys=True)
            if self._files.create(_manifest_path(self.root, new.number), text):
                self.staged, self._folders = {}, []
                return new
            live = live_manifest(self.spark, self.root, self._files)
        self.abandon()
        raise ReleaseConflict(f"other writers came first {ATTEMPTS} times")

    def abandon(self) -> None:
        """Remove what was staged and not committed."""
        for folder in self._folders:
            self._files.delete(folder)
        self.staged, self._folders = {}, []


def _nullable(schema: T.StructType) -> T.StructType:
    """Parquet columns are read back as nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def vacuum(spark: SparkSession, root: str, *, older_than_seconds: float, keep_releases: int = 2) -> list[str]:
    """Remove versions that none of the last releases names and that nobody has touched for a while.

    A folder counts as touched when it, or an entry of it, was last modified: a
    version that is still being written stays.  The live release always stays.
    Returns the removed folders.
    """
    files = Files(spark, root)
    numbers = _manifest_numbers(files)
    kept = numbers[-max(1, keep_releases):]
    named: set[str] = set()
    for n in kept:
        tables = json.loads(files.read(_manifest_path(files.root, n)) or '{"tables": {}}')["tables"]
        named |= {f"{table_folder(files.root, t)}/v={v['version']}" for t, v in tables.items()}
    before = time.time() * 1000 - older_than_seconds * 1000
    removed = []
    for schema, is_dir, _ in files.listing(files.root):
        if not is_dir or schema == LOG:
            continue
        for name, _, _ in files.listing(f"{files.root}/{schema}"):
            for version, _, touched in files.listing(f"{files.root}/{schema}/{name}"):
                folder = f"{files.root}/{schema}/{name}/{version}"
                if not version.startswith("v=") or folder in named or touched >= before:
                    continue
                if all(t < before for _, _, t in _below(files, folder)):
                    files.delete(folder)
                    removed.append(folder)
    # Manifests last: until a version's folder is gone, a manifest may still name it.
    for n in numbers[: -len(kept)] if kept else []:
        files.delete(_manifest_path(files.root, n))
    for name, _, touched in files.listing(f"{files.root}/{LOG}"):
        if name.endswith(".draft") and touched < before:
            files.delete(f"{files.root}/{LOG}/{name}")
    return removed


def _below(files: Files, folder: str) -> Iterator[tuple[str, bool, int]]:
    """All entries of a folder and its folders (a writer's files lie some levels deep)."""
    for entry in files.listing(folder):
        yield entry
        if entry[1]:
            yield from _below(files, f"{folder}/{entry[0]}")
