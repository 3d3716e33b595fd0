"""A store of tables on plain Parquet: buckets of cases, a log of versions.

The rows of a table are dealt to buckets by a hash of their case; a version
names the folders that make up each bucket.  A row lies with its case, so new
rows tell which buckets a write has to read.  A write makes new folders for the
buckets it touches and then creates the next version's log file, which only one
writer can: the others read the new version and try again, so no update is
lost.  New rows are added beside what is there; a bucket is rewritten only
where rows are replaced or deleted, or when it has many folders.  Readers take
one version and never see half a write.  Paths go through Spark only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.identity import finding_id
from evidentia.schemas import TABLES
from evidentia.sources.files import Files

#: Buckets of a new store's tables, folders of a bucket before it is rewritten;
#: versions, and time in milliseconds, that old files stay for running readers.
BUCKETS, MAX_FOLDERS, KEPT_VERSIONS, KEPT_MS = 64, 24, 8, 24 * 3600 * 1000
#: Tables whose files are sorted, so that their own statistics tell readers what
#: to skip: columns, and bytes of a row group.
SORTED = {"postings": (("case_id", "term"), 8 << 20)}
MAX_FINDINGS, MAX_FINDING_CHARS = 500, 600
#: Characters of the texts that one task indexes, at least and at most.
TASK_CHARS = (4 << 20, 32 << 20)
#: Ids of replaced units, of about 100 bytes, that are broadcast to the postings.
MAX_GONE_SENT = 1 << 20


# ---------------------------------------------------------------- changes as DataFrames


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with equal keys;
    of several new rows with a key one stays."""
    n = new.dropDuplicates(keys)
    return current.join(n.select(*keys), keys, "left_anti").unionByName(n, allowMissingColumns=True)


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Merge: non-null columns of ``changes`` win, other rows stay."""
    ch = changes.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in changes.columns if c not in keys))
    out = current.join(ch, keys, "left")
    return out.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in current.columns))


def merge_registry(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Registered documents: new ones are added, non-null fields of the later
    win."""
    cols = [c for c in current.columns if c not in keys]
    a = current.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in cols))
    have = [c for c in cols if c in new.columns]
    b = new.dropDuplicates(keys).select(*keys, *(F.col(c).alias(f"_b_{c}") for c in have))
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) if c in have else F.col(f"_a_{c}").alias(c) for c in cols))


def valid_offsets(units: DataFrame) -> Column:
    s, e = F.col("start_offset"), F.col("end_offset")
    return (s.isNull() & e.isNull()) | ((s >= 0) & (e >= s))


def check_units(units: DataFrame) -> DataFrame:
    """``units``; the write fails as a whole at a row with bad offsets."""
    if "start_offset" not in units.columns:
        return units
    ok = F.coalesce(valid_offsets(units), F.lit(False))
    told = F.when(ok, F.col("evidence_id")).otherwise(F.raise_error(F.concat(F.lit("bad offsets: "), F.col("evidence_id"))).cast("string"))
    return units.withColumn("evidence_id", told)


def append_findings(current: DataFrame, new: DataFrame, units: DataFrame, now: Column) -> DataFrame:
    """``current`` findings and those of ``new`` (case_id, achado,
    evidence_ids): not empty, all evidence known, text cut at 600 characters,
    one row per id, at most 500 per case.

    Rejected rows are simply not added; ``finding_errors`` names them.
    """
    good = _checked(new, units).filter("problem IS NULL").select("case_id", "achado_id", "achado", "evidence_ids").dropDuplicates(["case_id", "achado_id"])
    fresh = good.join(current.select("case_id", "achado_id"), ["case_id", "achado_id"], "left_anti")
    n = current.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window as W

    # ranked before the case's own count comes in: each task then sends no more than the limit on
    r = F.row_number().over(W.partitionBy("case_id").orderBy("achado_id"))
    fresh = fresh.withColumn("_r", r).filter(F.col("_r") <= MAX_FINDINGS).join(n, "case_id", "left").filter(F.coalesce("_n", F.lit(0)) + F.col("_r") <= MAX_FINDINGS)
    return current.unionByName(fresh.select("case_id", "achado_id", "achado", "evidence_ids", now.alias("registrado_em")))


def _checked(new: DataFrame, units: DataFrame) -> DataFrame:
    t = F.trim(F.coalesce("achado", F.lit("")))
    cut = F.when(F.length(t) > MAX_FINDING_CHARS, F.concat(F.substring(t, 1, MAX_FINDING_CHARS), F.lit(" …"))).otherwise(t)
    x = new.withColumn("achado", cut).withColumn("achado_id", finding_id(F.col("achado"), F.coalesce("evidence_ids", F.array().cast("array<string>"))))
    e = x.select("case_id", "achado_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    bad = e.join(units.select("evidence_id").distinct(), "evidence_id", "left_anti").groupBy("case_id", "achado_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("unknown"))
    x = x.join(bad, ["case_id", "achado_id"], "left")
    why = F.when(F.length("achado") == 0, "empty").when(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0, "no evidence").when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown: "), F.array_join("unknown", ", ")))
    return x.withColumn("problem", why)


def finding_errors(new: DataFrame, units: DataFrame) -> DataFrame:
    return _checked(new, units).filter("problem IS NOT NULL").select("case_id", "achado_id", "problem")


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.groupBy("case_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


# ---------------------------------------------------------------- the store


Entry = dict[str, list[str]]


class Store:
    """Tables under ``root``; see ``evidentia.schemas.TABLES``.

    The number of buckets is fixed by who writes first and kept with the store:
    a store of 100 TB wants some ten thousand, so that a bucket is some GB.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.files, self._asked = spark, root.rstrip("/"), Files(spark), buckets
        self._n: int | None = None

    @property
    def n_buckets(self) -> int:
        if self._n is None:
            path = f"{self.root}/buckets"
            said = self.files.read(path)
            if said is None:
                self.files.create(path, str(self._asked))
                said = self.files.read(path)
            self._n = int(said or self._asked)
        return self._n

    def bucket(self, case: Column) -> Column:
        return F.pmod(F.xxhash64(case), F.lit(self.n_buckets)).cast("int")

    # versions

    def _versions(self, table: str) -> list[int]:
        return [int(x) for x in self.files.names(f"{self.root}/{table}/log") if x.isdigit()]

    def _entry(self, table: str) -> tuple[int, Entry]:
        """The current version and its folders by bucket; 0 before any write."""
        while True:
            n = max(self._versions(table), default=0)
            raw = self.files.read(f"{self.root}/{table}/log/{n:012d}") if n else "{}"
            if raw is not None:
                return n, json.loads(raw)

    def _commit(self, table: str, n: int, entry: Entry) -> bool:
        entry = {b: f for b, f in entry.items() if f}
        if not self.files.create(f"{self.root}/{table}/log/{n:012d}", json.dumps(entry, sort_keys=True)):
            return False
        self._tidy(table, n)
        return True

    def _tidy(self, table: str, n: int) -> None:
        """Drop versions that are old by number and by age, and folders that
        only those name: a long scan keeps its files."""
        old = [v for v in self._versions(table) if v <= n - KEPT_VERSIONS]
        if len(old) < KEPT_VERSIONS:
            return
        # a version is in use until the next one replaces it
        before = int(time.time() * 1000) - KEPT_MS
        young = next((v for v in old if self.files.modified_ms(f"{self.root}/{table}/log/{v + 1:012d}") > before), None)
        old = [v for v in old if young is None or v < young]
        if not old:
            return
        load = lambda v: json.loads(self.files.read(f"{self.root}/{table}/log/{v:012d}") or "{}")
        folders = lambda vs: {f"{x}/_b={b}" for v in vs for b, xs in load(v).items() for x in xs}
        for f in folders(old) - folders(v for v in self._versions(table) if v > old[-1]):
            self.files.delete(f"{self.root}/{table}/data/{f}")
        for v in old:
            self.files.delete(f"{self.root}/{table}/log/{v:012d}")

    def _frame(self, table: str, entry: Entry, buckets: Iterable[int] | None = None) -> DataFrame:
        schema, _ = TABLES[table]
        wanted = entry if buckets is None else {str(b): entry.get(str(b), []) for b in buckets}
        paths = [f"{self.root}/{table}/data/{x}/_b={b}" for b, xs in sorted(wanted.items()) for x in xs]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _put(self, table: str, df: DataFrame, placed: DataFrame | None = None) -> tuple[str, set[str]]:
        """Rows as a new folder by bucket; its name and the buckets it has.
        ``placed`` rows lie with their buckets already."""
        schema, _ = TABLES[table]
        name = uuid.uuid4().hex
        path = f"{self.root}/{table}/data/{name}"

        def in_bucket(df: DataFrame) -> DataFrame:
            have = set(df.columns)
            cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
            return df.select(*cols).withColumn("_b", self.bucket(F.col("case_id")))

        # a large bucket is written by several tasks, small ones share one
        dealt = in_bucket(df).hint("rebalance", "_b")
        if placed is not None:
            dealt = dealt.union(in_bucket(placed))
        write = dealt.write
        if table in SORTED:
            order, group = SORTED[table]
            write = dealt.sortWithinPartitions("_b", *order).write.option("parquet.block.size", group)
        write.partitionBy("_b").parquet(path)
        return name, {x[3:] for x in self.files.names(path) if x.startswith("_b=")}

    def _buckets(self, df: DataFrame) -> set[int]:
        return {r[0] for r in df.select(self.bucket(F.col("case_id"))).distinct().collect()}  # at most n_buckets

    def _within(self, df: DataFrame) -> set[int] | None:
        """The buckets of rows that name their case; None: any."""
        return self._buckets(df) if "case_id" in df.columns else None

    # reading and writing

    def read(self, table: str, case_id: str | None = None) -> DataFrame:
        """The current version; of one case only its bucket is read."""
        _, entry = self._entry(table)
        if case_id is None:
            return self._frame(table, entry)
        own = self.spark.range(1).select(self.bucket(F.lit(case_id))).first()[0]
        return self._frame(table, entry, [own]).filter(F.col("case_id") == case_id)

    def near(self, table: str, rows: DataFrame) -> DataFrame:
        """The current version's buckets of the cases of ``rows``: all that can
        hold rows of those cases."""
        return self._frame(table, self._entry(table)[1], sorted(self._buckets(rows)))

    def change(
        self, table: str, touched: Callable[[DataFrame], set[int]], rows: Callable[[DataFrame], DataFrame], beside: Callable[[DataFrame], set[int]] = lambda _: set(), within: set[int] | None = None,
        placed: DataFrame | None = None,
    ) -> None:
        """Rewrite the buckets ``touched(current)`` as ``rows(current rows of
        those buckets)`` and ``placed``; what that gives for ``beside(current)`` is
        added to theirs.  ``current`` is read in the buckets ``within`` only, if given.
        If another writer was faster, the same again on its version, unless that
        left the same buckets alone."""
        while True:
            n, entry = self._entry(table)
            whole = self._frame(table, entry, None if within is None else sorted(within))
            old = touched(whole)
            new = beside(whole) - old
            old |= {b for b in new if len(entry.get(str(b), [])) >= MAX_FOLDERS}
            new -= old
            if not old and not new:
                return
            name, have = self._put(table, rows(self._frame(table, entry, sorted(old))), placed)
            looked_at = dict(entry)
            while True:
                made = {str(b): [name] * (str(b) in have) for b in old} | {str(b): [*entry.get(str(b), []), *[name] * (str(b) in have)] for b in new}
                if self._commit(table, n + 1, entry | made):
                    return
                n, entry = self._entry(table)
                if any(entry.get(str(b), []) != looked_at.get(str(b), []) for b in old | new):
                    break

    def write(self, table: str, df: DataFrame) -> None:
        """``df`` in place of all rows."""
        self.change(table, lambda _: set(range(self.n_buckets)), lambda _: df)

    def _holding(self, current: DataFrame, keys: DataFrame, names: list[str]) -> set[int]:
        return self._buckets(current.join(keys.select(*names).distinct(), names, "left_semi"))

    def upsert(self, table: str, new: DataFrame) -> None:
        """New rows; those with a key that is there are replaced."""
        names = list(TABLES[table][1])
        if table == "evidence_units":
            new = check_units(new)
        if "case_id" not in new.columns:
            new = new.withColumn("case_id", F.lit(None).cast("string"))
        own = self._buckets(new)
        self.change(table, lambda cur: self._holding(cur, new, names), lambda cur: upsert(cur, new, names), lambda _: own, own)

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> None:
        """Rows with the keys of ``gone``; where it names cases, of those only."""
        self.change(table, lambda cur: self._holding(cur, gone, keys), lambda cur: delete(cur, gone, keys), within=self._within(gone))

    def patch(self, table: str, changes: DataFrame) -> None:
        names = list(TABLES[table][1])
        self.change(table, lambda cur: self._holding(cur, changes, names), lambda cur: patch(cur, changes, names), within=self._within(changes))

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows beside those that are there: nothing is read."""
        own = self._buckets(rows)
        self.change(table, lambda _: set(), lambda cur: cur.unionByName(rows, allowMissingColumns=True), lambda _: own, set())

    def merge(self, table: str, cases: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> None:
        """The rows of the buckets of ``cases`` (case_id) as ``rows(current)``."""
        own = self._buckets(cases)
        self.change(table, lambda _: own, rows, within=own)

    def _beside_buckets(self, units: DataFrame) -> tuple[set[int], DataFrame]:
        """The buckets of ``units``, and those with text dealt to tasks by their
        bucket (``_b``): a large bucket to several, small ones to a common one.
        Texts are a fraction of the rows that an index makes of them."""
        at = units.withColumn("_b", self.bucket(F.col("case_id")))
        sizes = sorted((r[0], r[1]) for r in at.groupBy("_b").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).collect())  # at most n_buckets
        cores = self.spark.sparkContext.defaultParallelism
        most = min(max(sum(n for _, n in sizes) // (2 * cores), TASK_CHARS[0]), TASK_CHARS[1])
        rows, task, filled = [], 0, 0
        for b, n in sizes:
            if filled and filled + n > most:
                task, filled = task + 1, 0
            parts = max(1, -(-n // most))
            rows.append((b, task, parts))
            task, filled = (task, filled + n) if parts == 1 else (task + parts, 0)
        where = F.broadcast(self.spark.createDataFrame(rows, "_b int, _first int, _parts int"))
        task_id = (F.col("_first") + F.pmod(F.xxhash64("evidence_id"), F.col("_parts"))).cast("int")
        dealt = at.filter("text IS NOT NULL").join(where, "_b").repartitionById(task + 1, task_id).drop("_first", "_parts")
        return {b for b, _ in sizes}, dealt

    def index(self, units: DataFrame, postings: Callable[[DataFrame], DataFrame]) -> None:
        """The text index of new or changed ``units`` (case_id, evidence_id,
        text): their old postings go, ``postings`` of those with text are added,
        with a row of an empty term for each unit.

        Beside them go rows without a term: what the case gained in units (tf)
        and tokens (dl), of each task, less what replaced units had.  They are in
        the same version as the postings, so they can't differ from them; where a
        bucket is rewritten those that were there become one row for each case.
        """
        own, dealt = self._beside_buckets(units)
        ids = units.select("evidence_id").distinct()
        # a unit that is there has a row of an empty term: a few row groups are read
        there = lambda cur: cur.filter("term = ''").join(ids, "evidence_id", "left_semi")

        def rows(cur: DataFrame) -> DataFrame:
            lost = there(cur).select("case_id", F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"))
            before = cur.filter("term IS NULL").select("case_id", F.col("tf").alias("n"), "dl")
            sums = before.unionByName(lost).groupBy("case_id").agg(F.sum("n").alias("tf"), F.sum("dl").alias("dl"))
            gone = there(cur).select("evidence_id").distinct()
            # sent to the postings if they are few
            gone = F.broadcast(gone) if gone.limit(MAX_GONE_SENT + 1).count() <= MAX_GONE_SENT else gone.hint("shuffle_hash")
            kept = cur.filter("term IS NOT NULL").join(gone, "evidence_id", "left_anti")
            return kept.unionByName(sums, allowMissingColumns=True)

        self.change("postings", lambda cur: self._buckets(there(cur)), rows, lambda _: own, own, postings(dealt))
