"""A database of typed tables over Parquet, with snapshot transactions.

State lives in manifests: ``<root>/_log/<version>.json`` holds the whole catalog
of one version, and a commit publishes the next by an exclusive create. Data
files are immutable; rows carry a row id (insertion position) and the number of
the commit that wrote them. Inserted files are written once: their rows hold a
position (partition and place in it), and the manifest says at which row id each
partition starts. Statistics of zones of positions lie beside the files. A delete or an update writes the affected row ids,
and an update the new rows too; a scan drops rows that a later commit deleted.

Columns have physical names of their own, so renaming, dropping and adding
columns rewrites nothing. Readers pin a version: they see one snapshot for good.
"""

from __future__ import annotations

import bisect
import copy
import json
import os
import time
import uuid
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stats
from ..plans.filters import Compare, FilterSet
from ..plans.scan import ScanRequest, did_you_mean
from ..types import parse_type

ROWID, SEQ, POSITION = "__rowid", "__seq", "__position"
#: A position is a partition's number and, in the low bits, a row's place in it.
PLACE_BITS = 33
#: Starts of more partitions go to a file of their own, so that manifests stay small.
INLINE_STARTS = 64
#: A zone of stored statistics has 2 ** 17 rows.
ZONE_BITS = 17
#: What is younger than a week may belong to open transactions and pinned readers.
KEEP_SECONDS = 7 * 86400.0
DEFAULT_SCHEMAS = ("main", "pg_catalog", "information_schema", "temp")


_OWN = [T.StructField(ROWID, T.LongType()), T.StructField(SEQ, T.LongType())]


def _alike(entries: Iterable[dict], *keys: str) -> list[tuple[tuple, list[dict]]]:
    """The entries that agree in ``keys``, with what they agree in."""
    groups: dict[str, tuple[tuple, list[dict]]] = {}
    for e in entries:
        values = tuple(e[k] for k in keys)
        groups.setdefault(json.dumps(values, sort_keys=True), (values, []))[1].append(e)
    return list(groups.values())


class Starts:
    """Row ids at which partitions start, by partition number from ``first`` on. Both grow together."""

    def __init__(self, entries: Sequence[tuple[int, list[int]]]) -> None:
        entries = sorted(entries)
        self.first, self.ids = entries[0][0], []
        for part, ids in entries:
            self.ids += [ids[0]] * (part - self.first - len(self.ids)) + ids

    def rowid(self) -> Column:
        """A row's id by its position. The starts are one literal, however many there are."""
        if len(self.ids) == 1:
            return F.col(POSITION) + (self.ids[0] - (self.first << PLACE_BITS))
        starts = F.split(F.lit(",".join(map(str, self.ids))), ",").cast("array<long>")
        part = (F.shiftright(POSITION, PLACE_BITS) - self.first).cast("int")
        return F.get(starts, part) + F.col(POSITION).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def position(self, rowid: int) -> int:
        """Where a row id lies; one that no row has lies where no row is, between its neighbours."""
        k = bisect.bisect_right(self.ids, rowid) - 1
        if k < 0:
            return (self.first << PLACE_BITS) - 1
        return ((self.first + k) << PLACE_BITS) + min(rowid - self.ids[k], (1 << PLACE_BITS) - 1)


class DatabaseError(Exception):
    pass


class ConflictError(DatabaseError):
    """Another transaction committed a change to the same rows or object first."""


class Store:
    """Small files on whatever file system Spark's path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._util = jvm.org.apache.hadoop.io.IOUtils

    def create(self, name: str, text: str) -> bool:
        """Publish a file whole, under a name that must not exist yet; False if it does.

        The text goes to a file of its own first. A link (local disks) or a rename
        (file systems whose rename never replaces a file, as HDFS's) then gives it
        the name, so no reader sees a part of it and only one writer wins. Stores without such a
        rename (object stores, where two writers could both see no file) are refused.
        """
        if (scheme := self._fs.getUri().getScheme()) in ("s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos"):
            raise DatabaseError(f"{scheme} has no rename that only one writer wins; keep the database on HDFS or a mounted path")
        own = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(own), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return not self._fs.exists(self._path(name)) and self._fs.rename(self._path(own), self._path(name))
            os.link(*(self._path(p).toUri().getPath() for p in (own, name)))
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(own), False)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        data = bytes(self._util.readFullyToByteArray(stream))
        stream.close()
        return data.decode()

    def list(self, name: str) -> list[str]:
        if not self._fs.exists(self._path(name)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(name))]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def age(self, name: str) -> float:
        """Seconds since a file or folder changed."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000


def _folders(state: dict) -> set[str]:
    """The data folders that a manifest names."""
    entries = [e for s in state["schemas"].values() for t in s.values() for e in [*t["data"], *t["deletes"]]]
    return {e[k] for e in entries for k in ("dir", "zones") if k in e}


def _empty() -> dict:
    return {"version": 0, "schemas": {s: {} for s in DEFAULT_SCHEMAS}, "views": {}, "sequences": {}, "next": 1}


@dataclass
class Transaction:
    base: dict
    state: dict
    deleted: dict[str, list[str]] = field(default_factory=dict)
    touched: set[str] = field(default_factory=set)
    appended: dict[str, list[dict]] = field(default_factory=dict)


class Database:
    """Opens (or creates) the database under a root folder that all executors share.

    ``checkpoint_after``: a table that more data and delete entries make up is checkpointed by the commit that
    added the last, once the changes since its largest entry amount to half of that (so rewriting costs a constant
    share of what was written). None leaves it to ``checkpoint``.
    """

    def __init__(self, spark: SparkSession, root: str, zone_bits: int = ZONE_BITS, checkpoint_after: int | None = 32) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.zone_bits, self.checkpoint_after = zone_bits, checkpoint_after
        self._known: dict[str, list[int]] = {}
        self.store = Store(spark, self.root)
        if not self.store.list("_log"):
            self.store.create("_log/00000000.json", json.dumps(_empty()))

    def latest(self) -> dict:
        """The newest manifest that is whole; one that a crash cut short is passed over."""
        for name in sorted((n for n in self.store.list("_log") if n.endswith(".json")), reverse=True):
            with suppress(ValueError):
                return json.loads(self.store.read(f"_log/{name}"))
        raise DatabaseError("no whole manifest is left")

    def starts(self, entry: dict) -> list[int]:
        """Row ids at which the partitions of an insert start."""
        if entry["starts"] is not None:
            return entry["starts"]
        if entry["dir"] not in self._known:
            self._known[entry["dir"]] = json.loads(self.store.read(f"{entry['dir']}/_starts.json"))
        return self._known[entry["dir"]]

    def connect(self) -> Connection:
        return Connection(self)

    def publish(self, state: dict, after: int) -> bool:
        """Make ``state`` the next version; False if another commit came first."""
        names = sorted(n for n in self.store.list("_log") if n.endswith(".json"))
        for name in reversed(names):
            if int(name.split(".")[0]) <= after:
                break
            with suppress(ValueError):  # a file that can't be read is no version, but its number is taken
                json.loads(self.store.read(f"_log/{name}"))
                return False
        state["version"] = int(names[-1].split(".")[0]) + 1
        return self.store.create(f"_log/{state['version']:08d}.json", json.dumps(state))

    def vacuum(self, min_age: float = KEEP_SECONDS) -> None:
        """Drop data folders that no manifest names (of rolled-back or crashed transactions), and old manifests.

        What changed in the last ``min_age`` seconds stays, with all that manifests of that time name: open
        transactions have staged files there, and readers may have pinned those versions.
        """
        now = self.latest()
        live: set[str] = set()
        for name in self.store.list("_log"):
            if not name.endswith(".json"):
                continue
            if int(name.split(".")[0]) < now["version"] and self.store.age(f"_log/{name}") >= min_age:
                self.store.delete(f"_log/{name}")
                continue
            with suppress(ValueError):
                live |= _folders(json.loads(self.store.read(f"_log/{name}")))
        for name in self.store.list("data"):
            if f"data/{name}" not in live and self.store.age(f"data/{name}") >= min_age:
                self.store.delete(f"data/{name}")


class Connection:
    """A session on a database: autocommit, or begin / commit / rollback.

    With ``autocommit`` set to False, the first change begins a transaction that lasts until commit or rollback.
    """

    def __init__(self, db: Database) -> None:
        self.db, self.spark, self._txn = db, db.spark, None
        self.autocommit = True
        self._tag = f"rowstrata-{uuid.uuid4().hex}"

    # transactions
    @property
    def in_transaction(self) -> bool:
        return self._txn is not None

    def begin(self) -> None:
        if self._txn:
            raise DatabaseError("already in transaction")
        self._txn = self._new()

    def _new(self) -> Transaction:
        base = self.db.latest()
        return Transaction(base, copy.deepcopy(base))

    def commit(self) -> None:
        if not self._txn:
            raise DatabaseError("no transaction to commit")
        txn, self._txn = self._txn, None
        self._commit(txn)

    def rollback(self) -> None:
        """Staged files are forgotten; without a transaction nothing happens."""
        self._txn = None

    def close(self) -> None:
        self.rollback()

    @contextmanager
    def transaction(self):
        self.begin()
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.commit()

    @contextmanager
    def _write(self):
        """The open transaction, or one that commits by itself."""
        with self.jobs():
            if not self._txn and not self.autocommit:
                self.begin()
            if self._txn:
                yield self._txn
                return
            txn = self._new()
            yield txn
            self._commit(txn)

    @contextmanager
    def jobs(self):
        """Jobs that start inside belong to this connection, so that ``interrupt`` stops them."""
        context = self.spark.sparkContext
        held = self._tag in context.getJobTags()
        context.addJobTag(self._tag)
        try:
            yield self
        finally:
            if not held:
                context.removeJobTag(self._tag)

    def _commit(self, txn: Transaction) -> None:
        while True:
            now = self.db.latest()
            state = txn.state if now["version"] == txn.base["version"] else self._rebase(txn, now)
            if gone := [d for d in _folders(state) - _folders(now) if not self.db.store.exists(d)]:
                raise DatabaseError(f"staged files are gone: {sorted(gone)}")
            if self.db.publish(copy.deepcopy(state), now["version"]):
                break
        for key in sorted(txn.appended):
            self._checkpoint_if_due(key)

    def _checkpoint_if_due(self, key: str) -> None:
        schema, table = key.split(".", 1)
        t = self.db.latest()["schemas"].get(schema, {}).get(table)
        entries = [*t["data"], *t["deletes"]] if t else []
        if self.db.checkpoint_after is None or len(entries) <= self.db.checkpoint_after:
            return
        largest = max(e["rows"] for e in entries)
        if 2 * (sum(e["rows"] for e in entries) - largest) >= largest:
            with suppress(ConflictError):  # another commit came between; the next one will see to it
                self.checkpoint(key)

    def _rebase(self, txn: Transaction, now: dict) -> dict:
        """The transaction's state on top of a newer version. First committer wins, per object and per row."""
        state = copy.deepcopy(now)
        for name in txn.touched:
            if json.dumps(self._slot(now, name), sort_keys=True) != json.dumps(self._slot(txn.base, name), sort_keys=True):
                raise ConflictError(f"{name} was changed by another transaction")
            mine = self._slot(txn.state, name)
            kind, key = name.split(":", 1)
            if kind == "table":
                schema, table = key.split(".", 1)
                if schema not in state["schemas"]:
                    raise ConflictError(f"schema {schema} was dropped by another transaction")
                state["schemas"][schema].pop(table, None)
                if mine is not None:
                    state["schemas"][schema][table] = mine
            else:
                group = {"schema": "schemas", "view": "views", "sequence": "sequences"}[kind]
                state[group].pop(key, None)
                if mine is not None:
                    state[group][key] = mine
        for key, added in txn.appended.items():
            if f"table:{key}" in txn.touched:
                continue
            schema, table = key.split(".", 1)
            theirs = state["schemas"].get(schema, {}).get(table)
            before = txn.base["schemas"][schema][table]
            if theirs is None or theirs["columns"] != before["columns"]:
                raise ConflictError(f"{key} was changed by another transaction")
            if key in txn.deleted:
                if theirs.get("checkpoints") != before.get("checkpoints"):
                    raise ConflictError(f"{key} was checkpointed by another transaction")
                new = [e["dir"] for e in theirs["deletes"] if e not in before["deletes"]]
                if new and self._ids(txn.deleted[key]).join(self._ids(new), ROWID, "left_semi").limit(1).count():
                    raise ConflictError(f"rows of {key} were changed by another transaction")
            shift = theirs["next_rowid"] - before["next_rowid"]
            if shift and key in txn.deleted and self._ids(txn.deleted[key]).where(F.col(ROWID) >= before["next_rowid"]).limit(1).count():
                raise ConflictError(f"rows that this transaction put into {key} and changed got other ids")
            for e in added:
                moved = {"rowid_shift": e["rowid_shift"] + shift} if e["kind"] == "insert" else {}
                e = {**e, **moved, "seq_shift": e["seq_shift"] + state["next"] - e["seq"], "seq": state["next"]}
                state["next"] += 1
                theirs["deletes" if e["kind"] == "delete" else "data"].append(e)
            mine = txn.state["schemas"][schema][table]
            theirs["next_rowid"] += mine["next_rowid"] - before["next_rowid"]
            theirs["next_part"] = max(theirs["next_part"], mine["next_part"])
        return state

    @staticmethod
    def _slot(state: dict, name: str):
        kind, key = name.split(":", 1)
        if kind == "table":
            schema, table = key.split(".", 1)
            return state["schemas"].get(schema, {}).get(table)
        if kind == "schema":
            return sorted(state["schemas"][key]) if key in state["schemas"] else None
        return state[{"view": "views", "sequence": "sequences"}[kind]].get(key)

    def _ids(self, folders: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(f"{ROWID} long").parquet(*[f"{self.db.root}/{d}" for d in folders])

    @property
    def _state(self) -> dict:
        return self._txn.state if self._txn else self.db.latest()

    # catalog
    @staticmethod
    def _key(name: str) -> str:
        parts = name.lower().split(".")
        if not all(parts) or len(parts) > 2:
            raise DatabaseError(f"a table is named t or schema.t, not {name!r}")
        return ".".join(parts) if len(parts) == 2 else f"main.{parts[0]}"

    def _table(self, state: dict, name: str) -> dict:
        schema, table = self._key(name).split(".")
        if schema not in state["schemas"]:
            raise DatabaseError(f"no schema {schema!r}{did_you_mean(schema, list(state['schemas']))}")
        if table not in state["schemas"][schema]:
            raise DatabaseError(f"no table {name!r}{did_you_mean(table, list(state['schemas'][schema]))}")
        return state["schemas"][schema][table]

    def create_schema(self, name: str, on_conflict: str = "error") -> None:
        with self._write() as txn:
            if name.lower() in txn.state["schemas"]:
                if on_conflict == "ignore":
                    return
                raise DatabaseError(f"schema {name!r} exists")
            txn.state["schemas"][name.lower()] = {}
            txn.touched.add(f"schema:{name.lower()}")

    def drop_schema(self, name: str, cascade: bool = False) -> None:
        name = name.lower()
        with self._write() as txn:
            if name in DEFAULT_SCHEMAS:
                raise DatabaseError(f"schema {name!r} can't be dropped")
            if name not in txn.state["schemas"]:
                raise DatabaseError(f"no schema {name!r}")
            if txn.state["schemas"][name] and not cascade:
                raise DatabaseError(f"schema {name!r} holds tables")
            del txn.state["schemas"][name]
            txn.touched.add(f"schema:{name}")

    def create_table(self, name: str, columns: Sequence[tuple[str, str]], on_conflict: str = "error") -> None:
        """Columns as (name, type). ``on_conflict``: error, ignore or replace."""
        key = self._key(name)
        schema, table = key.split(".")
        names = [c.lower() for c, _ in columns]
        if not columns or len(set(names)) < len(names):
            raise DatabaseError("a table has columns, of different names")
        with self._write() as txn:
            if schema not in txn.state["schemas"]:
                raise DatabaseError(f"no schema {schema!r}")
            if table in txn.state["schemas"][schema]:
                if on_conflict == "ignore":
                    return
                if on_conflict != "replace":
                    raise DatabaseError(f"table {name!r} exists")
            defs = [{"id": f"c{i}", "name": c, "type": str(parse_type(t)), "default": None, "since": 0} for i, (c, t) in enumerate(columns)]
            txn.state["schemas"][schema][table] = {"columns": defs, "data": [], "deletes": [], "next_rowid": 0, "next_part": 0, "next_column": len(defs), "alters": 0}
            txn.touched.add(f"table:{key}")

    def drop_table(self, name: str) -> None:
        key = self._key(name)
        with self._write() as txn:
            self._table(txn.state, name)
            schema, table = key.split(".")
            del txn.state["schemas"][schema][table]
            txn.touched.add(f"table:{key}")

    def tables(self) -> list[str]:
        return sorted(t for s in self._state["schemas"].values() for t in s)

    def get_schema(self, name: str = "main") -> dict[str, list[tuple[str, str]]]:
        state = self._state
        if name.lower() not in state["schemas"]:
            raise DatabaseError(f"no schema {name!r}")
        return {t: [(c["name"], c["type"]) for c in d["columns"]] for t, d in state["schemas"][name.lower()].items()}

    # alterations change the manifest alone
    @contextmanager
    def _alter(self, name: str):
        with self._write() as txn:
            t = self._table(txn.state, name)
            t["alters"] += 1
            yield t
            txn.touched.add(f"table:{self._key(name)}")

    @staticmethod
    def _column(t: dict, name: str) -> dict:
        for c in t["columns"]:
            if c["name"].lower() == name.lower():
                return c
        raise DatabaseError(f"no column {name!r}{did_you_mean(name, [c['name'] for c in t['columns']])}")

    def add_column(self, table: str, name: str, kind: str, default: object = None, if_not_exists: bool = False) -> None:
        with self._alter(table) as t:
            if any(c["name"].lower() == name.lower() for c in t["columns"]):
                if if_not_exists:
                    return
                raise DatabaseError(f"column {name!r} exists")
            t["columns"].append({"id": f"c{t['next_column']}", "name": name, "type": str(parse_type(kind)), "default": default, "since": t["alters"]})
            t["next_column"] += 1

    def drop_column(self, table: str, name: str, if_exists: bool = False) -> None:
        with self._alter(table) as t:
            if if_exists and not any(c["name"].lower() == name.lower() for c in t["columns"]):
                return
            if len(t["columns"]) == 1:
                raise DatabaseError("a table keeps a column at least")
            t["columns"].remove(self._column(t, name))

    def rename_column(self, table: str, name: str, to: str) -> None:
        with self._alter(table) as t:
            self._column(t, name)["name"] = to

    def alter_type(self, table: str, name: str, kind: str) -> None:
        """The new type; stored values are cast when they are read."""
        with self._alter(table) as t:
            self._column(t, name)["type"] = str(parse_type(kind))

    def set_default(self, table: str, name: str, default: object) -> None:
        """The value for columns that an insert leaves out; stored rows keep theirs."""
        with self._alter(table) as t:
            self._column(t, name)["fill"] = default

    def set_not_null(self, table: str, name: str, on: bool = True) -> None:
        """Refuse NULLs from now on; rows stored before must hold none."""
        with self._alter(table) as t:
            c = self._column(t, name)
            if on and self._rows(t).where(F.col(c["id"]).isNull()).limit(1).count():
                raise DatabaseError(f"{name} holds NULLs")
            c["not_null"] = on

    def comment(self, table: str, text: str | None, column: str | None = None) -> None:
        with self._alter(table) as t:
            (self._column(t, column) if column else t)["comment"] = text

    def rename_table(self, name: str, to: str) -> None:
        key, new = self._key(name), self._key(to)
        with self._write() as txn:
            t = self._table(txn.state, name)
            schema, table = new.split(".")
            if schema not in txn.state["schemas"]:
                raise DatabaseError(f"no schema {schema!r}{did_you_mean(schema, list(txn.state['schemas']))}")
            if table in txn.state["schemas"][schema]:
                raise DatabaseError(f"table {to!r} exists")
            old_schema, old = key.split(".")
            del txn.state["schemas"][old_schema][old]
            txn.state["schemas"][schema][table] = t
            txn.touched |= {f"table:{key}", f"table:{new}"}

    def create_view(self, name: str, sql: str, on_conflict: str = "error") -> None:
        """``on_conflict``: error, ignore or replace."""
        with self._write() as txn:
            if name.lower() in txn.state["views"]:
                if on_conflict == "ignore":
                    return
                if on_conflict != "replace":
                    raise DatabaseError(f"view {name!r} exists")
            txn.state["views"][name.lower()] = sql
            txn.touched.add(f"view:{name.lower()}")

    def drop_view(self, name: str) -> None:
        self._drop("view", name)

    def rename_view(self, name: str, to: str) -> None:
        with self._write() as txn:
            views = txn.state["views"]
            if name.lower() not in views:
                raise DatabaseError(f"no view {name!r}{did_you_mean(name, list(views))}")
            if to.lower() in views:
                raise DatabaseError(f"view {to!r} exists")
            views[to.lower()] = views.pop(name.lower())
            txn.touched |= {f"view:{name.lower()}", f"view:{to.lower()}"}

    def views(self) -> dict[str, str]:
        return dict(self._state["views"])

    def _drop(self, kind: str, name: str) -> None:
        with self._write() as txn:
            entries = txn.state[f"{kind}s"]
            if name.lower() not in entries:
                raise DatabaseError(f"no {kind} {name!r}{did_you_mean(name, list(entries))}")
            del entries[name.lower()]
            txn.touched.add(f"{kind}:{name.lower()}")

    def view(self, name: str) -> DataFrame:
        """A view's rows; its SQL sees the tables of main in this snapshot."""
        views = self._state["views"]
        if name.lower() not in views:
            raise DatabaseError(f"no view {name!r}{did_you_mean(name, list(views))}")
        for t in self._state["schemas"]["main"]:
            self.scan(t).createOrReplaceTempView(t)
        return self.spark.sql(views[name.lower()])

    def create_sequence(self, name: str, start: int = 1, increment: int = 1, least: int = 1, most: int = 2**63 - 1, cycle: bool = False) -> None:
        with self._write() as txn:
            txn.state["sequences"][name.lower()] = {"next": start, "increment": increment, "least": least, "most": most, "cycle": cycle}
            txn.touched.add(f"sequence:{name.lower()}")

    def drop_sequence(self, name: str) -> None:
        self._drop("sequence", name)

    def next_value(self, name: str) -> int | None:
        """The next value of a sequence; None when it is spent."""
        with self._write() as txn:
            s = txn.state["sequences"][name.lower()]
            value = s["next"]
            if not s["least"] <= value <= s["most"]:
                if not s["cycle"]:
                    return None
                value = s["least"] if s["increment"] > 0 else s["most"]
            s["next"] = value + s["increment"]
            txn.touched.add(f"sequence:{name.lower()}")
            return value

    def next_values(self, name: str, count: int) -> range:
        """A block of ``count`` values, taken by one commit: shorter where the sequence ends, and never around a cycle's turn."""
        with self._write() as txn:
            s = txn.state["sequences"][name.lower()]
            start, step = s["next"], s["increment"]
            if s["cycle"] and not s["least"] <= start <= s["most"]:
                start = s["least"] if step > 0 else s["most"]
            left = ((s["most"] - start) // step if step > 0 else (start - s["least"]) // -step) + 1 if s["least"] <= start <= s["most"] else 0
            got = range(start, start + step * min(count, left), step)
            s["next"] = start + step * len(got)
            txn.touched.add(f"sequence:{name.lower()}")
            return got

    # rows
    def _folder(self) -> str:
        return f"data/{uuid.uuid4().hex}"

    def _physical(self, t: dict, df: DataFrame) -> list:
        """The declared columns of ``df``, checked and cast, under their physical names."""
        known = {c.lower(): c for c in df.columns}
        names = {c["name"].lower() for c in t["columns"]}
        left_out = {c["name"].lower() for c in t["columns"] if "fill" in c} - set(known)
        if set(known) | left_out != names:
            raise DatabaseError(f"columns {[c['name'] for c in t['columns']]} are asked for, not {df.columns}")
        out = []
        for c in t["columns"]:
            spec, key = parse_type(c["type"]), c["name"].lower()
            col = F.col(f"`{known[key]}`") if key in known else F.lit(c["fill"])
            if c.get("not_null"):
                col = F.coalesce(col, F.raise_error(F.lit(f"{c['name']} takes no NULL")))
            if (wrong := spec.check(col)) is not None:
                col = F.when(F.assert_true(~wrong, f"a value of {c['name']} is no {c['type']}").isNull(), col)
            out.append(col.cast(spec.spark()).alias(c["id"]))
        return out

    def insert(self, table: str, rows: DataFrame | Sequence[Sequence]) -> int:
        """Append rows; they get the next row ids, in the order of the DataFrame's partitions."""
        key = self._key(table)
        with self._write() as txn:
            t = self._table(txn.state, table)
            if not isinstance(rows, DataFrame):
                schema = T.StructType([T.StructField(c["name"], parse_type(c["type"]).spark()) for c in t["columns"]])
                rows = self.spark.createDataFrame(list(rows), schema).coalesce(1)
            body = rows.select(*self._physical(t, rows))
            folder, seq, first = self._folder(), self._seq(txn), t["next_part"]
            position = F.monotonically_increasing_id() + F.lit(first << PLACE_BITS)
            body.select("*", position.alias(POSITION), F.lit(seq).cast("long").alias(SEQ)).write.parquet(f"{self.db.root}/{folder}")
            zones = self._measure(t, folder, POSITION)
            # a row per partition, however many rows there are; counted in the files, as a second run of the plan may cut them otherwise
            part = F.shiftright("zone", PLACE_BITS - self.db.zone_bits).cast("long")
            counts = dict(tuple(r) for r in self._read(zones).groupBy(part).agg(F.sum("rows")).collect())
            total = sum(counts.values())
            if not total:
                for gone in (folder, zones):
                    self.db.store.delete(gone)
                return 0
            starts, t["next_part"] = [], max(counts) + 1
            for p in range(first, t["next_part"]):
                starts.append(t["next_rowid"])
                t["next_rowid"] += counts.get(p, 0)
            if len(starts) > INLINE_STARTS:
                self.db.store.create(f"{folder}/_starts.json", json.dumps(starts))
            entry = {"dir": folder, "kind": "insert", "at": POSITION, "rows": total, "zones": zones, "part": first}
            self._add(txn, key, t, entry | {"starts": starts if len(starts) <= INLINE_STARTS else None}, seq)
            return total

    def _read(self, *folders: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.db.root}/{d}" for d in folders])

    def _measure(self, t: dict, folder: str, at: str) -> str:
        """Write the statistics of a folder's zones, from one pass over its files."""
        kinds = {c["id"]: parse_type(c["type"]).spark() for c in t["columns"]}
        stored = T.StructType([*[T.StructField(i, k) for i, k in kinds.items()], T.StructField(at, T.LongType())])
        df = self.spark.read.schema(stored).parquet(f"{self.db.root}/{folder}")
        out = self._folder()
        ordered = [i for i, k in kinds.items() if stats.has_order(k)]
        stats.zones(df, ordered, at, self.db.zone_bits).write.parquet(f"{self.db.root}/{out}")
        return out

    @staticmethod
    def _seq(txn: Transaction) -> int:
        txn.state["next"] += 1
        return txn.state["next"] - 1

    def _add(self, txn: Transaction, key: str, t: dict, entry: dict, seq: int) -> None:
        """Record files whose rows hold their ids and ``seq``. A rebase shifts both without writing them again."""
        entry |= {"seq": seq, "rowid_shift": 0, "seq_shift": 0, "alters": t["alters"], "types": {c["id"]: c["type"] for c in t["columns"]}}
        t["deletes" if entry["kind"] == "delete" else "data"].append(entry)
        txn.appended.setdefault(key, []).append(entry)

    def _rows(self, t: dict, ids: Sequence[int] | None = None, span: tuple[int, int] | None = None, filters: FilterSet | None = None) -> DataFrame:
        """All visible rows with their row ids. Files of one kind are read by one scan, however many commits wrote them.

        ``ids`` and ``span`` (first and last) choose rows by id; they reach the files as tests on positions.
        ``filters`` leave out zones that can't hold matching rows; they don't filter rows.
        """
        parts: DataFrame | None = None
        for (types, alters, moved, later, at), entries in _alike(t["data"], "types", "alters", "rowid_shift", "seq_shift", "at"):
            columns = []
            for c in t["columns"]:
                col = F.col(c["id"]) if c["id"] in types else F.lit(c["default"] if c["since"] > alters else None)
                columns.append(col.cast(parse_type(c["type"]).spark()).alias(c["id"]))
            stored = T.StructType([*[T.StructField(i, parse_type(k).spark()) for i, k in types.items()], T.StructField(at, T.LongType()), T.StructField(SEQ, T.LongType())])
            df = self.spark.read.schema(stored).parquet(*[f"{self.db.root}/{e['dir']}" for e in entries])
            rowid, position = F.col(ROWID), int
            if at == POSITION:
                starts = Starts([(e["part"], self.db.starts(e)) for e in entries])
                rowid, position = starts.rowid(), starts.position
            if ids is not None:
                df = df.where(F.col(at).isin(*[position(int(i) - moved) for i in ids]))
            if span is not None:
                df = df.where(F.col(at).between(*[position(int(i) - moved) for i in span]))
            if filters is not None:
                df = self._pruned(df, t, types, entries, at, filters)
            df = df.select(*columns, (rowid + moved).alias(ROWID), (F.col(SEQ) + later).alias(SEQ))
            parts = df if parts is None else parts.unionByName(df)
        if parts is None:
            parts = self.spark.createDataFrame([], T.StructType([T.StructField(c["id"], parse_type(c["type"]).spark()) for c in t["columns"]] + _OWN))
        gone: DataFrame | None = None
        for (later,), entries in _alike(t["deletes"], "seq_shift"):
            d = self.spark.read.schema(T.StructType(_OWN)).parquet(*[f"{self.db.root}/{e['dir']}" for e in entries])
            d = d.select(F.col(ROWID).alias("__gone"), (F.col(SEQ) + later).alias("__at"))
            gone = d if gone is None else gone.unionByName(d)
        if gone is not None:
            gone = gone.groupBy("__gone").agg(F.max("__at").alias("__at"))
            parts = parts.join(gone, (F.col(ROWID) == F.col("__gone")) & (F.col("__at") > F.col(SEQ)), "left_anti")
        return parts

    def _pruned(self, df: DataFrame, t: dict, types: dict, entries: Sequence[dict], at: str, filters: FilterSet) -> DataFrame:
        """The rows of zones that may match. A column whose type has changed since prunes nothing."""
        names = {c["name"].lower(): c["id"] for c in t["columns"] if types.get(c["id"]) == c["type"] and stats.has_order(parse_type(c["type"]).spark())}
        known = FilterSet()
        for name, f in filters:
            if name.lower() in names:
                known.push(names[name.lower()], f)
        if not len(known):
            return df
        return stats.in_zones(df, stats.zones_kept(self._read(*[e["zones"] for e in entries]), known), at, self.db.zone_bits)

    def statistics(self, table: str) -> DataFrame:
        """A row per ordered column, from stored statistics alone: row_count, value_count, min_value, max_value, approx_distinct.

        They cover stored rows: after deletes and updates, until a checkpoint, counts hold superseded rows too and
        bounds may be wider than the visible rows. Columns added or retyped since the files were written, and
        tables without rows, have no row here.
        """
        t = self._table(self._state, table)
        names = {c["id"]: c["name"] for c in t["columns"] if stats.has_order(parse_type(c["type"]).spark()) and all(e["types"].get(c["id"]) == c["type"] for e in t["data"])}
        if not t["data"] or not names:
            return self.spark.createDataFrame([], "column_name string, row_count long, value_count long, min_value string, max_value string, approx_distinct long")
        parts: DataFrame | None = None
        for _, entries in _alike(t["data"], "types"):
            df = self._read(*[e["zones"] for e in entries]).select("rows", *names)
            parts = df if parts is None else parts.unionByName(df)
        return stats.zone_summary(parts, names)

    def _named(self, t: dict, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c["id"]).alias(c["name"]) for c in t["columns"]], F.col(ROWID).alias("rowid"))

    def scan(self, table: str, request: ScanRequest | None = None, rowid: bool = False, pruned: bool = False) -> DataFrame:
        """The rows of this snapshot; ``rowid`` adds the virtual row id column.

        ``pruned`` first asks the stored statistics which zones may hold rows that the request wants, and reads those alone.
        """
        t = self._table(self._state, table)
        df = self._named(t, self._rows(t, filters=request.filters if pruned and request is not None else None))
        if request is not None:
            return request.apply(df if rowid or "rowid" in [f for f, _ in request.filters] or "rowid" in request.columns else df.drop("rowid"))
        return df if rowid else df.drop("rowid")

    def top(self, table: str, column: str, limit: int, offset: int = 0, descending: bool = False) -> DataFrame:
        """``limit`` rows after ``offset`` in the order of a column, NULLs last, ties by row id.

        While no row has been deleted or updated, stored statistics bound what these rows hold, and zones and row
        groups beyond the bound are not read.
        """
        t = self._table(self._state, table)
        c = self._column(t, column)
        bounded = not t["deletes"] and t["data"] and all(e["types"].get(c["id"]) == c["type"] for e in t["data"])
        filters = None
        if bounded and limit + offset > 0 and isinstance(parse_type(c["type"]).spark(), (T.NumericType, T.StringType, T.DateType)):
            stored = self._read(*[e["zones"] for e in t["data"]]).select(c["id"])
            if (bound := stats.order_bound(stored, c["id"], limit + offset, descending)) is not None:
                filters = FilterSet().push(c["name"], Compare(">=" if descending else "<=", bound))
        rows = self._rows(t, filters=filters)
        if filters is not None:
            rows = rows.where(filters.get(c["name"]).column(F.col(c["id"])))
        order = F.col(c["id"]).desc_nulls_last() if descending else F.col(c["id"]).asc_nulls_last()
        return self._named(t, rows.orderBy(order, ROWID).offset(offset).limit(limit)).drop("rowid")

    def fetch(self, table: str, rowids: Sequence[int] | DataFrame) -> DataFrame:
        """Rows by row id."""
        if isinstance(rowids, DataFrame):
            return self.scan(table, rowid=True).join(rowids.select(F.col(rowids.columns[0]).cast("long").alias("rowid")).distinct(), "rowid", "left_semi")
        t = self._table(self._state, table)
        return self._named(t, self._rows(t, ids=rowids))

    def scan_range(self, table: str, start: int, end: int) -> DataFrame:
        """Rows with start <= rowid < end."""
        t = self._table(self._state, table)
        return self._named(t, self._rows(t, span=(start, end - 1)))

    def _wanted(self, rowids: Sequence[int] | DataFrame) -> DataFrame:
        if isinstance(rowids, DataFrame):
            return rowids.select(F.col(rowids.columns[0]).cast("long").alias(ROWID)).distinct()
        return self.spark.createDataFrame([(int(i),) for i in set(rowids)], f"{ROWID} long")

    def delete(self, table: str, rowids: Sequence[int] | DataFrame) -> int:
        """Delete rows by id; ids without a visible row count for nothing."""
        key = self._key(table)
        with self._write() as txn:
            t = self._table(txn.state, table)
            folder = self._folder()
            live = self._rows(t).select(ROWID).join(self._wanted(rowids), ROWID, "left_semi")
            seq = self._seq(txn)
            live.withColumn(SEQ, F.lit(seq).cast("long")).write.parquet(f"{self.db.root}/{folder}")
            n = self._ids([folder]).count()
            if n:
                self._add(txn, key, t, {"dir": folder, "kind": "delete", "rows": n}, seq)
                txn.deleted.setdefault(key, []).append(folder)
            return n

    def update(self, table: str, changes: DataFrame, columns: Sequence[str] | None = None) -> int:
        """Set columns of rows by id: ``changes`` has rowid and the new values. An unknown id is an error.

        Only the changed rows are written again, under their row ids.
        """
        key = self._key(table)
        names = list(columns or [c for c in changes.columns if c.lower() != "rowid"])
        with self._write() as txn:
            t = self._table(txn.state, table)
            ids = {self._column(t, n)["id"]: n for n in names}
            new = changes.select(F.col("rowid").cast("long").alias("__id"), *[F.col(n).alias(f"__new_{i}") for i, n in ids.items()])
            rows = self._rows(t)
            kinds = {c["id"]: parse_type(c["type"]).spark() for c in t["columns"]}
            joined = rows.join(new, F.col(ROWID) == F.col("__id"))
            fresh = joined.select(*[(F.col(f"__new_{i}").cast(k) if i in ids else F.col(i)).alias(i) for i, k in kinds.items()], ROWID)
            folder, before, after = self._folder(), self._seq(txn), self._seq(txn)
            fresh.withColumn(SEQ, F.lit(after).cast("long")).write.parquet(f"{self.db.root}/{folder}")
            n = self.spark.read.schema(f"{ROWID} long").parquet(f"{self.db.root}/{folder}")
            found, asked = n.count(), changes.count()
            if found != asked:
                self.db.store.delete(folder)
                raise DatabaseError(f"{asked} rows were to be updated, {found} exist: unknown or repeated row ids")
            gone = self._folder()
            n.withColumn(SEQ, F.lit(before).cast("long")).write.parquet(f"{self.db.root}/{gone}")
            self._add(txn, key, t, {"dir": gone, "kind": "delete", "rows": found}, before)
            txn.deleted.setdefault(key, []).append(gone)
            self._add(txn, key, t, {"dir": folder, "kind": "update", "at": ROWID, "rows": found, "zones": self._measure(t, folder, ROWID)}, after)
            return found

    def checkpoint(self, table: str) -> None:
        """Write the table's visible rows as one set of files; row ids stay."""
        key = self._key(table)
        with self._write() as txn:
            t = self._table(txn.state, table)
            folder, seq = self._folder(), self._seq(txn)
            self._rows(t).withColumn(SEQ, F.lit(seq).cast("long")).write.parquet(f"{self.db.root}/{folder}")
            t["data"], t["deletes"], t["checkpoints"] = [], [], t.get("checkpoints", 0) + 1
            zones = self._measure(t, folder, ROWID)
            rows = self._read(zones).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            self._add(txn, key, t, {"dir": folder, "kind": "compact", "at": ROWID, "rows": rows, "zones": zones}, seq)
            txn.touched.add(f"table:{key}")

    def copy_from(self, table: str, path: str, format: str = "parquet", **options) -> int:
        """Insert the rows of files; text formats are read with the table's types, never inferred."""
        t = self._table(self._state, table)
        schema = T.StructType([T.StructField(c["name"], parse_type(c["type"]).spark()) for c in t["columns"]])
        reader = self.spark.read.options(**options)
        return self.insert(table, (reader.schema(schema) if format in ("csv", "json") else reader).format(format).load(path))

    def copy_to(self, table: str, path: str, format: str = "parquet", request: ScanRequest | None = None, **options) -> None:
        """Write the visible rows (or those of a request) as files."""
        self.scan(table, request).write.options(**options).format(format).save(path)

    def files(self, table: str) -> list[Mapping]:
        """What the manifest holds of a table's data."""
        t = self._table(self._state, table)
        return [*t["data"], *t["deletes"]]

    def interrupt(self) -> None:
        """Stop the running jobs of this connection: its writes, and what runs inside ``jobs()``."""
        self.spark.sparkContext.cancelJobsWithTag(self._tag)
