"""The derived tables as versions: written beside what is read, told by one file, kept, restored and brought up to a schema.

A version is a folder of Parquet for each table that changed and one line of JSON that names the folders of all tables.
That file is written last and by renaming, so a reader sees a version whole or not at all, and a job that dies leaves
the last one as it was. A version's folders are never written again: a backup is a copy of its own, a restore is a new version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as X
from ..operators.rules import effective_repository, episode_scope, memory_scope
from ..operators.snapshots import superseded_duplicates

#: The schema that :func:`migrated` brings tables up to.
SCHEMA = 15


class Store:
    """Versions of named tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{"schema": number, "tables": {name: folders}} of a version, by default the last; without any version, no tables."""
        known = self.versions()
        if version is None and not known:
            return {"schema": SCHEMA, "tables": {}}
        return self._told(f"versions/{known[-1] if version is None else version:09d}.json")

    def _told(self, name: str) -> dict:
        at = f"{self.root}/{name}"
        if not self._fs.exists(self._path(at)):
            raise FileNotFoundError(f"no such version or backup: {at}")
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def _tell(self, name: str, manifest: dict) -> bool:
        """Write a manifest by renaming; False where one of that name is there already."""
        draft, at = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(at.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            return False
        return True

    def kept(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written beside the versions and read back, so that what is done on them does not make them again."""
        at = f"{self.root}/work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def clear_work(self) -> None:
        """Remove what :meth:`kept` wrote; call it when nothing reads that any more."""
        self._fs.delete(self._path(f"{self.root}/work"), True)

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        told = self.manifest(version)["tables"]
        if table not in told:
            raise KeyError(f"no table {table} in this version")
        return self._read(told[table])

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{at}" for at in folders])

    def _written(self, tables: dict[str, DataFrame], below: str) -> dict[str, list[str]]:
        out = {}
        for name, rows in tables.items():
            out[name] = [f"{below}/{name}/{uuid.uuid4().hex}"]
            rows.write.parquet(f"{self.root}/{out[name][0]}")
        return out

    def commit(self, tables: dict[str, DataFrame], schema: int = SCHEMA, base: int | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """A new version: the given tables, and all others as they were in ``base`` (the last version, where none is named).

        Rows of ``append`` are added to a table's folders, which are not written again. The frames may read the store itself. A version that another writer has committed since is not overwritten: the
        call fails, and may be made again upon the newer one.
        """
        known = self.versions()
        base = base if base is not None else (known[-1] if known else None)
        before = self.manifest(base)["tables"] if base is not None else {}
        folders = self._written(tables, "data")
        folders |= {name: [*before.get(name, []), *at] for name, at in self._written(append or {}, "data").items()}
        version = (base or 0) + 1 if base is None or base == known[-1] else None
        if version is None or not self._tell(f"versions/{version:09d}.json", {"schema": schema, "tables": before | folders}):
            raise RuntimeError(f"version {base} is not the last one any more")
        return version

    def backup(self, name: str, version: int | None = None) -> str:
        """A copy of all tables of a version under ``backups``, which outlasts :meth:`prune`."""
        told = self.manifest(version)
        folders = self._written({t: self.read(t, version) for t in told["tables"]}, f"backups/{name}")
        if not self._tell(f"backups/{name}.json", {"schema": told["schema"], "tables": folders}):
            raise FileExistsError(f"backup {name} is there already")
        return name

    def backups(self) -> list[str]:
        return sorted(n.removesuffix(".json") for n in self._names("backups") if n.endswith(".json"))

    def restore(self, name: str, migrate: Callable[[dict[str, DataFrame], int], dict[str, DataFrame]] | None = None) -> int:
        """A new version that holds the tables of a backup alone, brought up to the schema where the backup is older."""
        told = self._told(f"backups/{name}.json")
        tables = {t: self._read(at) for t, at in told["tables"].items()}
        known = self.versions()
        folders = self._written((migrate or migrated)(tables, told["schema"]), "data")
        version = (known[-1] if known else 0) + 1
        if not self._tell(f"versions/{version:09d}.json", {"schema": SCHEMA, "tables": folders}):
            raise RuntimeError("another version was committed meanwhile")
        return version

    def prune(self, keep: int) -> int:
        """Remove all but the last ``keep`` versions (one at least), and the folders that none of these names; the number of folders that went."""
        known = self.versions()
        held = known[-max(keep, 1) :]
        used = {at for v in held for folders in self.manifest(v)["tables"].values() for at in folders}
        for v in known[: len(known) - len(held)]:
            self._fs.delete(self._path(f"{self.root}/versions/{v:09d}.json"), False)
        stale = [at for t in self._names("data") for n in self._names(f"data/{t}") if (at := f"data/{t}/{n}") not in used]
        for at in stale:
            self._fs.delete(self._path(f"{self.root}/{at}"), True)
        return len(stale)


def snapshot_before(store: Store, name: str, candidates: int, policy: str = "auto") -> str | None:
    """The backup that a run over so many candidates makes first: none without candidates or with the policy ``never``."""
    if policy not in ("auto", "never"):
        raise ValueError(f"the policy is auto or never, not {policy}")
    return store.backup(name) if candidates > 0 and policy == "auto" else None


#: Columns that a schema added to a table, with their types and what older rows get.
ADDED = (
    (3, "memory", "scope", "string", "repo"), (3, "episode", "scope", "string", "repo"),
    (5, "memory", "scope_source", "string", "auto"), (5, "episode", "scope_source", "string", "auto"),
    *[(5, table, f"scope_override_{field}", "string", None) for table in ("memory", "episode") for field in ("actor", "reason", "source", "at")],
    (7, "memory", "canonical_key", "string", None), (7, "memory", "reinforcement_count", "int", 1), (7, "memory", "last_seen_at", "timestamp", None),
    (10, "improvement", "proposal_type", "string", None), (10, "improvement", "proposal_path", "string", None), (10, "improvement", "proposal_hash", "string", None),
    (10, "improvement", "review_state", "string", "none"), (14, "memory", "domain_key", "string", None), (14, "memory", "expires_at", "timestamp", None),
)


def with_columns(rows: DataFrame, table: str, before: int) -> DataFrame:
    """``rows`` with the columns that later schemas added to the table; those that are there already stay."""
    new = {c: F.lit(value).cast(kind) for since, t, c, kind, value in ADDED if t == table and since > before and c not in rows.columns}
    return rows.withColumns(new) if new else rows


def migrated(tables: dict[str, DataFrame], before: int, schema: int = SCHEMA, now: Column | None = None) -> dict[str, DataFrame]:
    """Tables of schema ``before`` brought up to ``schema``: columns are added, never dropped, and what they stand for is made anew.

    Before 4 the scopes of all memories and episodes are classified from what they say; before 5 rows have no
    scope_source, and get ``auto``; before 7 memories get their canonical keys, a reinforcement and the time when last seen, and
    user identities of one key become one (:func:`superseded_duplicates`). Other tables, and tables of the schema already, stay as they are.
    """
    if before >= schema:
        return tables
    out = {name: with_columns(rows, name, before) for name, rows in tables.items()}
    if "memory" in out:
        out["memory"] = _memory(out["memory"], before, F.current_timestamp() if now is None else now)
    if "episode" in out:
        out["episode"] = _episode(out["episode"], before)
    return out


def _placed(rows: DataFrame, scope: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.withColumn("scope", scope).withColumn("repository", effective_repository(F.col("scope"), F.nullif(F.trim("repository"), F.lit("")), none, none))


def _memory(rows: DataFrame, before: int, now: Column) -> DataFrame:
    if before < 4:
        said = rows.withColumn("_said", F.concat_ws(" ", "type", "content", F.coalesce("tags", F.lit("")))).withColumn("_name", X.assistant_name(F.col("_said")))
        rows = _placed(said, memory_scope(F.col("type"), F.col("_said"), F.nullif(F.trim("repository"), F.lit("")), F.lit(None).cast("string"), F.col("_name"))).drop("_said", "_name")
    if before < 5:
        rows = rows.withColumn("scope_source", F.coalesce("scope_source", F.lit("auto")))
    if before < 7:
        key = F.coalesce("canonical_key", F.when(F.col("superseded_by").isNull(), X.canonical_key(F.col("type"), F.col("content"))))
        count = F.greatest(F.coalesce("reinforcement_count", F.lit(1)), F.lit(1))
        rows = rows.withColumns({"canonical_key": key, "reinforcement_count": count, "last_seen_at": F.coalesce("last_seen_at", "updated_at")})
        rows = superseded_duplicates(rows, "user_identity", now)
    return rows


def _episode(rows: DataFrame, before: int) -> DataFrame:
    if before < 4:
        rows = _placed(rows, episode_scope(F.col("open_items"), F.coalesce("summary", F.lit("")), F.lit(None).cast("string")))
    return rows.withColumn("scope_source", F.coalesce("scope_source", F.lit("auto"))) if before < 5 else rows


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; without that setting, as in tests, below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
