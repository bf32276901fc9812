"""Tables under one state: a manifest names what every table consists of, and is put in place last.

Rows are written to folders of their own that never change. A state is a small file that lists, for
each table, the folders that are its rows; committing a state is one operation that fails if another
writer has taken its number. So readers see all tables of a state or none of it: a crash in between
leaves the state before, and of two writers the second one is told (and `transact` runs it again on
what the first one left). Older states stay readable: a snapshot is a name for one of them, and
restoring makes an old state the newest.

A table can be dealt into buckets by the hash of a key. Reading by keys then reads only their buckets,
and changing rows rewrites only buckets that lose rows; buckets that only gain rows get one more folder.
Where a table loses few of its rows in most of its buckets, `Draft.hide` writes the keys of these beside it
instead, and reading leaves their rows out. Folders that no state names (of failed writers) stay until `vacuum`.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandgraph.sources.durable import stored

_BUCKET = "_bucket"
#: Folders of one bucket before it is written anew as one.
MOST_PARTS = 16
#: Times that rows were hidden before a table is written anew without them.
MOST_HIDDEN = 4
#: Keys that are sent to all tasks that read a table; with more of them, both are shuffled.
MOST_SENT = 1_000_000


def _folder(part: list) -> str:
    return part[1].split("/")[0]


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Broken(ValueError):
    """A state that breaks rules and was not put in place; rows (rule, key, n) are the keys at fault."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        super().__init__("the new state breaks: " + ", ".join(r["rule"] for r in rows.select("rule").distinct().orderBy("rule").collect()))


class State:
    """What all tables are at one time."""

    def __init__(self, catalog: Catalog, number: int, tables: dict, rules: list):
        self.catalog, self.number, self.tables, self.rules = catalog, number, tables, rules

    def __contains__(self, table: str) -> bool:
        return table in self.tables

    def schema(self, table: str) -> StructType:
        return StructType.fromJson(self._entry(table)["schema"])

    def _entry(self, table: str) -> dict:
        if table not in self.tables:
            raise LookupError(f"no version of {table}")
        return self.tables[table]

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame:
        """The table's rows; with keys (a frame whose first column holds keys), those of its keys' buckets,
        joined down to the keys."""
        entry = self._entry(table)
        if keys is None:
            return self.parts(table, None)
        key, few = entry["key"] or keys.columns[0], False
        if entry["key"]:
            spread = self._spread(table, keys)
            rows, few = self.parts(table, set(spread)), sum(spread.values()) <= MOST_SENT
        else:
            rows = self.parts(table, None)
        keys = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        return rows.join(F.broadcast(keys) if few else keys, key, "left_semi").select(*rows.columns)

    def known(self, table: str, keys: DataFrame) -> DataFrame:
        """(key) of those keys that the table has rows of; of its rows only keys are read and shuffled."""
        key = self._entry(table)["key"]
        have = self.parts(table, self.buckets_of(table, keys)).select(key).distinct()
        return have.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")

    def buckets_of(self, table: str, keys: DataFrame) -> set[int]:
        """The buckets that hold keys: at most as many numbers as the table has buckets."""
        return set(self._spread(table, keys))

    def _spread(self, table: str, keys: DataFrame) -> dict[int, int]:
        """How many of the keys, repeats included, are in which bucket."""
        entry = self._entry(table)
        kind = self.schema(table)[entry["key"]].dataType  # equal numbers of other types have other hashes
        bucket = F.pmod(F.xxhash64(F.col(keys.columns[0]).cast(kind)), F.lit(entry["buckets"]))
        return dict(map(tuple, keys.groupBy(bucket.cast("int")).count().collect()))

    def parts(self, table: str, buckets: set[int] | None) -> DataFrame:
        """The rows of some buckets, or of all."""
        entry, schema, read = self._entry(table), self.schema(table), self.catalog.spark.read
        within = lambda parts: [self.catalog.path(p) for b, p in parts if buckets is None or b in buckets]
        hidden: dict[tuple, list] = {}  # parts by what of their rows is hidden
        for part in entry["parts"]:
            hidden.setdefault(tuple(i for i, h in enumerate(entry.get("hidden", [])) if _folder(part) in h["of"]), []).append(part)
        found = None
        for by, parts in hidden.items():
            paths = within(parts)
            if not paths:
                continue
            rows = read.schema(schema).parquet(*paths)
            for h in (entry["hidden"][i] for i in by):
                if gone := within(h["parts"]):
                    keys = read.schema(StructType([schema[c] for c in h["on"]])).parquet(*gone)
                    same = [rows[c].eqNullSafe(keys[c]) for c in h["on"]]
                    rows = rows.join(F.broadcast(keys) if h["n"] <= MOST_SENT else keys, same, "left_anti")
            found = rows if found is None else found.unionByName(rows)
        return self.catalog.spark.createDataFrame([], schema) if found is None else found


class Draft(State):
    """A state in the making: reads see its own changes, nobody else does before it is committed."""

    def __init__(self, base: State):
        super().__init__(base.catalog, base.number + 1, dict(base.tables), list(base.rules))
        self.changed: set[str] = set()

    def _set(self, table: str, entry: dict) -> None:
        before = self.tables.get(table)
        fresh = table not in self.changed
        self.changed.add(table)
        version = (before["version"] + fresh) if before else 1
        self.tables[table] = entry | {"version": version}

    def put(self, table: str, entry: dict) -> None:
        """Take rows that `Catalog.deal` has written as the table."""
        self._set(table, entry)

    def write(self, table: str, rows: DataFrame, key: str | None = None, buckets: int = 64) -> None:
        """Replace a table; with a key it is dealt into buckets, as it is if it was before."""
        old = self.tables.get(table)
        if key is None and old and old["key"] in rows.columns:
            key, buckets = old["key"], old["buckets"]
        self._set(table, self.catalog.deal(rows, key, buckets))

    def append(self, table: str, rows: DataFrame) -> None:
        if table not in self.tables:
            self.write(table, rows)
            return
        old = self._entry(table)
        new = self.catalog.deal(rows.select(*self.schema(table).names), old["key"], old["buckets"])
        self._set(table, old | {"parts": old["parts"] + new["parts"]})
        self._compact(table)

    def change(self, table: str, gone: DataFrame, rows: DataFrame, on: list[str] | None = None) -> None:
        """Take away the rows that match gone on its columns `on` (by default the key), and add rows.

        Only buckets that may lose rows are rewritten. gone must have the table's key.
        """
        old = self._entry(table)
        key = old["key"]
        gone = stored(gone)
        lose = self.buckets_of(table, gone.select(key)) & {b for b, _ in old["parts"]}
        rows = rows.select(*self.schema(table).names)
        if lose:
            before = self.parts(table, lose)
            matched = before.join(gone.select(*(on or [key])).distinct(), on or [key], "left_anti").select(*before.columns)
            rows = matched.unionByName(rows)
        new = self.catalog.deal(rows, key, old["buckets"])
        self._set(table, old | {"parts": [p for p in old["parts"] if p[0] not in lose] + new["parts"]})
        self._compact(table)

    def hide(self, table: str, gone: DataFrame, rows: DataFrame, on: list[str] | None = None) -> None:
        """As `change`, but no bucket is rewritten: what gone says is written beside the table and left out on reading,
        until that has been done MOST_HIDDEN times. For few rows of many buckets. Nulls in gone match nulls."""
        old, schema = self._entry(table), self.schema(table)
        on = on or [old["key"]]
        keys = self.catalog.deal(gone.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in on]).distinct(), old["key"], old["buckets"])
        new = self.catalog.deal(rows.select(*schema.names), old["key"], old["buckets"])
        entry = old | {"parts": old["parts"] + new["parts"]}
        if keys["parts"]:
            n = self.catalog.spark.read.parquet(*[self.catalog.path(p) for _, p in keys["parts"]]).count()
            entry["hidden"] = [*old.get("hidden", []), {"parts": keys["parts"], "on": on, "n": n, "of": sorted({_folder(p) for p in old["parts"]})}]
        self._set(table, entry)
        self._compact(table)

    def upsert(self, table: str, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """merge(old rows, new rows) for the buckets that new rows fall into; the others stay."""
        old = self._entry(table)
        new = stored(new)
        touched = self.buckets_of(table, new.select(old["key"]))
        rows = merge(self.parts(table, touched), new).select(*self.schema(table).names)
        entry = self.catalog.deal(rows, old["key"], old["buckets"])
        self._set(table, old | {"parts": [p for p in old["parts"] if p[0] not in touched] + entry["parts"]})

    def _compact(self, table: str) -> None:
        """Buckets of too many folders become one folder each; a table of which rows were hidden too often is written anew."""
        entry = self.tables[table]
        if len(entry.get("hidden", [])) > MOST_HIDDEN:
            self._set(table, self.catalog.deal(self.parts(table, None), entry["key"], entry["buckets"]))
            return
        count: dict[int, int] = {}
        for b, _ in entry["parts"]:
            count[b] = count.get(b, 0) + 1
        full = {b for b, n in count.items() if n > MOST_PARTS}
        if full:
            new = self.catalog.deal(self.parts(table, full), entry["key"], entry["buckets"])
            self._set(table, entry | {"parts": [p for p in entry["parts"] if p[0] not in full] + new["parts"]})

    def declare_key(self, table: str, *columns: str) -> None:
        """No two rows of the table may agree on these columns, and none may be null."""
        self._declare({"rule": f"key {table}({', '.join(columns)})", "table": table, "columns": list(columns)})

    def declare_reference(self, table: str, column: str, to: str, to_column: str) -> None:
        """Every value of the column that isn't null must be in the other table."""
        self._declare({"rule": f"reference {table}.{column} to {to}.{to_column}", "table": table, "columns": [column], "to": to, "to_column": to_column})

    def _declare(self, rule: dict) -> None:
        self.rules = [r for r in self.rules if r["rule"] != rule["rule"]] + [rule]
        self.changed.add(rule["table"])

    def broken(self) -> DataFrame | None:
        """(rule, key, n): keys that break a rule of a changed table, and in how many rows."""
        found = None
        for r in self.rules:
            if not {r["table"], r.get("to")} & self.changed or r["table"] not in self.tables:
                continue
            cols = [F.col(c) for c in r["columns"]]
            named = F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
            rows = self.read(r["table"])
            if "to" in r:
                there = self.read(r["to"]).select(F.col(r["to_column"]).alias(r["columns"][0])) if r["to"] in self.tables else rows.limit(0).select(cols[0])
                bad = rows.where(cols[0].isNotNull()).join(there, r["columns"][0], "left_anti").groupBy(named.alias("key")).agg(F.count("*").alias("n"))
            else:
                null = sum((c.isNull().cast("int") for c in cols), F.lit(0)) > 0
                bad = rows.groupBy(*cols).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null).select(named.alias("key"), "n")
            one = bad.select(F.lit(r["rule"]).alias("rule"), "key", "n")
            found = one if found is None else found.unionByName(one)
        return found


class Catalog:
    """A folder of states and of the rows they name. Paths go through Spark's file system layer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def path(self, part: str) -> str:
        return f"{self.root}/data/{part}"

    # --- states ---

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("states") if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> State:
        found = self.numbers()
        return self.state(found[-1]) if found else State(self, 0, {}, [])

    def state(self, number: int) -> State:
        text = self._text(f"states/{number:012d}.json")
        if text is None:
            raise LookupError(f"no state {number}")
        told = json.loads(text)
        return State(self, number, told["tables"], told["rules"])

    def commit(self, draft: Draft) -> State:
        """Put the draft in place as the next state; Conflict if that number is taken, Broken if rules are."""
        broken = draft.broken()
        if broken is not None:
            rows = stored(broken)
            if not rows.isEmpty():
                raise Broken(rows)
        told = {"tables": draft.tables, "rules": draft.rules, "at": time.time()}
        if not self._put_new(f"states/{draft.number:012d}.json", json.dumps(told)):
            raise Conflict(f"state {draft.number} is taken")
        return State(self, draft.number, draft.tables, draft.rules)

    def transact(self, edit: Callable[[Draft], None], tries: int = 20) -> State:
        """Run edit on a draft of the last state and commit it; after a conflict, again on what is there then."""
        for left in range(tries, 0, -1):
            draft = Draft(self.last())
            edit(draft)
            try:
                return self.commit(draft)
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    # --- live and snapshots ---

    def snapshot(self, name: str, number: int | None = None) -> int:
        """Name a state (the last one by default); a name stays with its state."""
        number = number or self.last().number
        if not self._put_new(f"snapshots/{name}.json", json.dumps({"state": number})):
            raise Conflict(f"there is a snapshot {name}")
        return number

    def at(self, name: str | None = None) -> State:
        """The live state, or that of a snapshot."""
        if name is None:
            return self.last()
        text = self._text(f"snapshots/{name}.json")
        if text is None:
            raise LookupError(f"no snapshot {name}")
        return self.state(json.loads(text)["state"])

    def restore_all(self, number: int) -> State:
        """All tables as they were, as a new state."""
        def back(draft: Draft) -> None:
            old = self.state(number)
            draft.tables, draft.rules = dict(old.tables), list(old.rules)

        return self.transact(back)

    def vacuum(self, keep: int = 10, idle_seconds: float = 86_400) -> int:
        """Delete folders that neither the last states nor a snapshot name, if older than idle_seconds
        (writers may still be on their way with younger ones); their number."""
        kept = set(self.numbers()[-keep:]) | {json.loads(self._text(f"snapshots/{n}"))["state"] for n in self._names("snapshots") if n.endswith(".json")}
        named = {_folder(p) for k in kept for e in self.state(k).tables.values() for x in (e, *e.get("hidden", [])) for p in x["parts"]}
        for k in set(self.numbers()) - kept:
            self._fs.delete(self._path(f"{self.root}/states/{k:012d}.json"), False)
        gone = 0
        for s in self._fs.listStatus(self._path(f"{self.root}/data")) if self._fs.exists(self._path(f"{self.root}/data")) else []:
            if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 > idle_seconds:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # --- single tables ---

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table's last version, or an older one."""
        if version is None:
            return self.last().read(table)
        return self._with_version(table, version).read(table)

    def versions(self, table: str) -> list[int]:
        """The versions that led to the table's present one."""
        now = self.last()
        return sorted({s.tables[table]["version"] for s in map(self.state, self.numbers()) if table in s and s.tables[table]["version"] <= now.tables[table]["version"]}) if table in now else []

    def _with_version(self, table: str, version: int) -> State:
        for number in reversed(self.numbers()):
            state = self.state(number)
            if table in state and state.tables[table]["version"] == version:
                return state
        raise LookupError(f"no version {version} of {table}")

    def write(self, table: str, rows: DataFrame, key: str | None = None, buckets: int = 64) -> int:
        """A new version. Rows are written once; only the commit is tried again."""
        old = self.last().tables.get(table)
        if key is None and old and old["key"] in rows.columns:
            key, buckets = old["key"], old["buckets"]
        entry = self.deal(rows, key, buckets)
        return self.transact(lambda d: d.put(table, entry)).tables[table]["version"]

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table that is only ever added to; no other writer's rows are lost."""
        self.transact(lambda d: d.append(table, rows))

    def restore(self, table: str, version: int) -> None:
        """The table as it was at that version."""
        entry = self._with_version(table, version).tables[table]

        def back(draft: Draft) -> None:
            draft.put(table, entry)
            draft.tables[table] = entry

        self.transact(back)

    # --- files ---

    def deal(self, rows: DataFrame, key: str | None, buckets: int) -> dict:
        """Write rows to a new folder, by buckets if there is a key: the entry of a table."""
        name = uuid.uuid4().hex
        entry = {"schema": rows.schema.jsonValue(), "key": key, "buckets": buckets if key else 0}
        if not key:
            rows.write.parquet(self.path(name))
            return entry | {"parts": [[-1, name]]}
        bucketed = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        bucketed.hint("rebalance", F.col(_BUCKET)).sortWithinPartitions(_BUCKET, key).write.partitionBy(_BUCKET).parquet(self.path(name))
        found = sorted(int(n.split("=")[1]) for n in self._names(f"data/{name}") if n.startswith(f"{_BUCKET}="))
        return entry | {"parts": [[b, f"{name}/{_BUCKET}={b}"] for b in found]}

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_new(self, name: str, text: str) -> bool:
        """Write a file under a name that isn't taken yet, whole or not at all; False if it is taken.

        The file is written aside and renamed without overwriting, which HDFS and its like do as one
        step. A local file system's rename looks first and then moves, so there a hard link is made.
        """
        aside, target = self._path(f"{self.root}/aside/{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside)
        out.write(text.encode())
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(aside, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except FileExistsError:
            return False
        except Exception as error:  # Java's FileAlreadyExistsException by name: its class isn't Python's
            if "FileAlreadyExists" in str(error):
                return False
            raise
        finally:
            if self._fs.exists(aside):
                self._fs.delete(aside, False)
        return True
