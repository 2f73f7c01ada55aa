"""Keyed memo tables with a TTL, as table operations (M1-M9).

A memo table is a keyed DataFrame with a ``cached_at`` timestamp. The state of a memo log
is the latest version per key, computed as a grouped ``max_by`` (partial aggregation on
the map side, so a key written a million times costs one row per task in the shuffle).
Lookups are equi-joins on the key; AQE turns them into broadcast joins only when the
measured size of a side is under the broadcast threshold. ``as_of`` is always a
parameter; nothing reads the clock inside a plan.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _ts(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def is_expired(cached_at="cached_at", as_of=None, hours: int = 24) -> Column:
    """M4: strictly older than as_of - hours; a missing timestamp counts as expired."""
    c = F.col(cached_at) if isinstance(cached_at, str) else cached_at
    limit = F.timestamp_add("HOUR", F.lit(-hours), _ts(as_of))
    return F.coalesce(c.cast("timestamp_ntz") < limit, F.lit(True))


def current(log: DataFrame, key: str, order=("cached_at",)) -> DataFrame:
    """Latest entry per key of a memo log (last write wins, ordered by ``order``)."""
    others = [c for c in log.columns if c != key]
    latest = F.max_by(F.struct(*others), F.struct(*order))
    return log.groupBy(key).agg(latest.alias("_r")).select(key, "_r.*")


def live(memo: DataFrame, as_of, hours: int = 24, ts: str = "cached_at") -> DataFrame:
    return memo.filter(~is_expired(ts, as_of, hours))


def memo_lookup(keys: DataFrame, memo: DataFrame, key: str, as_of, hours: int = 24) -> DataFrame:
    """M1: every requested key with ``hit`` and the live payload columns (null on a miss)."""
    hits = live(memo, as_of, hours).withColumn("_hit", F.lit(True))
    return (keys.select(key).distinct().join(hits, key, "left")
                .withColumn("hit", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))


def memo_misses(keys: DataFrame, memo: DataFrame, key: str, as_of, hours: int = 24) -> DataFrame:
    """M2: requested keys without a live entry (what must be computed)."""
    return keys.select(key).distinct().join(live(memo, as_of, hours).select(key), key, "left_anti")


def memo_upsert(existing: DataFrame, new: DataFrame, key: str, order=("cached_at",)) -> DataFrame:
    """M3: insert-or-replace by key; rows of ``new`` replace existing ones."""
    both = (existing.withColumn("_src", F.lit(0))
                    .unionByName(new.withColumn("_src", F.lit(1))))
    return current(both, key, ("_src", *order)).drop("_src")


def memo_purge(tables: dict[str, DataFrame], as_of, hours: int = 24, ts: str = "cached_at"):
    """M5: drop expired entries of every table; returns (kept tables, counts per table)."""
    kept = {n: live(df, as_of, hours, ts) for n, df in tables.items()}
    counts = None
    for n, df in tables.items():
        e = is_expired(ts, as_of, hours)
        c = df.agg(F.lit(n).alias("table_name"), F.count_if(e).alias("purged"), F.count_if(~e).alias("kept"))
        counts = c if counts is None else counts.unionByName(c)
    return kept, counts


def memo_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """M6: number of entries per table."""
    out = None
    for n, df in tables.items():
        c = df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("entries"))
        out = c if out is None else out.unionByName(c)
    return out


def memo_delete(memo: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """M7: remove entries whose key is in ``keys``."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    return memo.join(k, key, "left_anti")


def memo_delete_cascade(posts: DataFrame, comments: DataFrame, keys: DataFrame, post_key: str = "url",
                        comment_post_key: str = "post_url"):
    """M7: deleting a post also deletes its comments."""
    return (memo_delete(posts, keys, post_key),
            memo_delete(comments, keys.select(F.col(post_key).alias(comment_post_key)), comment_post_key))


def memo_clear_all(memo: DataFrame) -> DataFrame:
    """M8: an empty table with the same schema."""
    return memo.filter(F.lit(False))


def memo_reuse(keys: DataFrame, memo: DataFrame, key: str, payload: str, compute, as_of,
               hours: int = 24) -> DataFrame:
    """M9: reuse live entries that carry a payload (``from_cache`` true); compute the rest.

    ``compute`` maps the DataFrame of missing keys to (key, payload).
    """
    usable = memo.filter(F.col(payload).isNotNull())
    hits = (live(usable, as_of, hours).join(keys.select(key).distinct(), key, "left_semi")
            .select(key, payload, F.lit(True).alias("from_cache")))
    misses = memo_misses(keys, usable, key, as_of, hours)
    fresh = compute(misses).select(key, payload, F.lit(False).alias("from_cache"))
    return hits.unionByName(fresh)


class MemoConflict(RuntimeError):
    """Another writer has committed first."""


class MemoStore:
    """A memo table as a log of runs under a shared folder.

    A write adds one run: a folder of Parquet files holding only the written rows (or, for removed
    keys, tombstones), partitioned by a hash of the key into ``buckets``; a lookup reads the buckets
    of its keys alone. A commit is a small file ``_commits/<version>`` listing the live runs, oldest
    first; readers follow the highest one. It is renamed into place, which fails if the version
    exists already (as a stream's own log does), so of two writers one has to look again. The rows of
    a key in later runs replace those in earlier ones.

    Runs are merged when the later ones together hold as many rows as one before them, so there are
    O(log n) runs and a row is rewritten O(log n) times. Nothing is overwritten while it may be
    read; ``vacuum`` deletes the runs that the last commits don't list.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, retries: int = 3):
        self.spark, self.root, self.buckets, self.retries = spark, root.rstrip("/"), buckets, retries

    # -- commits

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._hadoop(f"{self.root}/_commits")
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def _commit(self, version: int | None) -> dict:
        """The commit of a version: the merge key and its runs (folder, rows), oldest first."""
        if version is None:
            return {"key": None, "runs": []}
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{version:012d}", wholetext=True).first()[0])

    def _head(self) -> tuple[int | None, dict]:
        versions = self.versions()
        head = versions[-1] if versions else None
        return head, self._commit(head)

    def _publish(self, version: int, commit: dict) -> int:
        target, fs = self._hadoop(f"{self.root}/_commits/{version:012d}")
        draft, _ = self._hadoop(f"{self.root}/_commits/.{version:012d}-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(commit).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)       # without OVERWRITE: fails if it exists
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.toString():
                raise MemoConflict(f"version {version} of {self.root} was committed by another writer") from e
            raise
        return version

    # -- runs

    @staticmethod
    def _bucket(key: str | None, buckets: int) -> Column:
        return F.lit(0) if key is None else F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def _write_run(self, df: DataFrame, key: str | None) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self._bucket(key, self.buckets))
        if key is not None:
            # a bucket's rows in one or more tasks: AQE splits a large one
            rows = rows.hint("rebalance", "_bucket")
        rows.write.mode("errorifexists").partitionBy("_bucket").parquet(f"{self.root}/runs/{name}")
        path = f"{self.root}/runs/{name}"
        return {"run": name, "rows": self.spark.read.schema(rows.schema).parquet(path).count(),
                "buckets": None if key is None else self.buckets, "schema": rows.schema.json()}

    def _read_run(self, run: dict, wanted=None) -> DataFrame:
        """A run, or of a keyed one the buckets in ``wanted`` (number of buckets -> theirs)."""
        schema = StructType.fromJson(json.loads(run["schema"]))
        df = self.spark.read.schema(schema).parquet(f"{self.root}/runs/{run['run']}")
        return df if not wanted or run["buckets"] is None else df.where(F.col("_bucket").isin(wanted[run["buckets"]]))

    def _merged(self, commit: dict, runs: list[dict], wanted=None) -> DataFrame:
        """The latest row per key of ``runs``, tombstones included."""
        both = None
        for i, run in enumerate(runs):
            df = self._read_run(run, wanted).withColumn("_run", F.lit(i))
            both = df if both is None else both.unionByName(df, allowMissingColumns=True)
        if len(runs) > 1:
            both = current(both, commit["key"], ("_run",))
        return both.drop("_run", "_bucket")

    def _live(self, commit: dict, wanted=None) -> DataFrame:
        df = self._merged(commit, commit["runs"], wanted)
        return df.where("_gone is null").drop("_gone") if "_gone" in df.columns else df

    def _append(self, key: str, run: dict) -> int:
        """Commit a run behind the head, merging the runs that it outgrows."""
        for attempt in range(self.retries + 1):
            head, commit = self._head()
            if commit["key"] not in (None, key):
                raise ValueError(f"the table's key is {commit['key']}, not {key}")
            try:
                return self._append_to(head, commit, key, run)
            except MemoConflict:
                if attempt == self.retries:
                    raise

    def _append_to(self, head: int | None, commit: dict, key: str, run: dict) -> int:
        runs, commit = [*commit["runs"], run], {"key": key}
        first = next((i for i in range(len(runs) - 1) if sum(r["rows"] for r in runs[i + 1:]) >= runs[i]["rows"]), None)
        if first is not None:
            merged = self._merged(commit, runs[first:])
            if first == 0 and "_gone" in merged.columns:
                merged = merged.where("_gone is null").drop("_gone")
            runs = [*runs[:first], self._write_run(merged, key)]
        return self._publish((head or 0) + 1, {**commit, "runs": runs})

    # -- the table

    def read(self, schema=None) -> DataFrame | None:
        head, commit = self._head()
        if head is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self._live(commit)

    def lookup(self, keys: DataFrame, as_of, hours: int = 24) -> DataFrame:
        """M1 over the buckets of ``keys`` alone (their numbers, at most ``buckets``, come to the driver)."""
        _, commit = self._head()
        key = commit["key"]
        wanted = {n: [r[0] for r in keys.select(self._bucket(key, n).alias("b")).distinct().collect()]
                  for n in {run["buckets"] for run in commit["runs"]} - {None}}
        return memo_lookup(keys, self._live(commit, wanted), key, as_of, hours)

    def write(self, df: DataFrame, key: str | None = None) -> int:
        """Replace the whole table; of two writers the second fails."""
        head, commit = self._head()
        key = key or commit["key"]
        return self._publish((head or 0) + 1, {"key": key, "runs": [self._write_run(df, key)]})

    def upsert(self, new: DataFrame, key: str, order=("cached_at",)) -> int:
        """M3: writes the rows of ``new`` and no others, but for merges of runs."""
        return self._append(key, self._write_run(current(new, key, order), key))

    def _remove(self, keys: DataFrame, key: str) -> None:
        gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
        self._append(key, self._write_run(gone, key))

    def purge(self, as_of, hours: int = 24) -> tuple[int, int] | None:
        """M5: drop expired entries; the numbers of entries purged and kept."""
        head, commit = self._head()
        if head is None:
            return None
        cur, e = self._live(commit), is_expired("cached_at", as_of, hours)
        n = cur.agg(F.count_if(e), F.count_if(~e)).first()
        if n[0]:
            if commit["key"] is None:
                self.write(live(cur, as_of, hours))
            else:
                self._remove(cur.where(e), commit["key"])
        return n[0], n[1]

    def delete(self, keys: DataFrame, key: str) -> None:
        """M7: remove the entries of ``keys``; writes one tombstone each."""
        head, commit = self._head()
        if head is not None:
            hit = self._live(commit).join(keys.select(key).distinct(), key, "left_semi")
            self._remove(hit.select(key), key)

    def clear(self) -> None:
        """M8: remove all entries; the schema stays."""
        cur = self.read()
        if cur is not None:
            self.write(memo_clear_all(cur))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the runs that none of the last ``keep`` commits lists, and the older commits. For a
        time without writers: a run not yet committed is listed nowhere."""
        versions = self.versions()
        used = {r["run"] for v in versions[-keep:] for r in self._commit(v)["runs"]}
        path, fs = self._hadoop(f"{self.root}/runs")
        old = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName() not in used] if versions else []
        for v in versions[:-keep]:
            fs.delete(self._hadoop(f"{self.root}/_commits/{v:012d}")[0], False)
        for p in old:
            fs.delete(p, True)
        return [p.getName() for p in old]
