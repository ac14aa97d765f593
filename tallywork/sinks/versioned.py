"""Keyed tables as an append-only Parquet table of changes.

A commit appends its rows under three partition columns: `_version` in the order of commits, `_kind` (`change` for rows that are put
or deleted, `whole` for all rows of the table as of then) and `_mark`, which says who writes it, for instance which batch of which
stream. Partitions are overwritten dynamically, so a commit that is repeated replaces its own partition and no other, whatever has
been appended in between. A table is read from its last whole state and the changes behind it, of which the latest wins by key;
an ordinary job appends a new whole state now and then.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywork.session import remove_folder

_PARTITION = re.compile(r"/_version=(\d+)/_kind=(change|whole)/_mark=([0-9a-f]+)/[^/]*$")
CHANGE, WHOLE = "change", "whole"
PUT, DELETE, BEGIN = "put", "delete", "begin"
# Changes are folded into a new whole state once they have this share of its rows, so that each row is rewritten a few times only.
FOLD_SHARE = 0.25


class Commit(NamedTuple):
    version: int
    kind: str
    mark: str


@dataclass(frozen=True)
class VersionedTable:
    spark: SparkSession
    root: str
    schema: str
    keys: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    def _typed(self, rows: DataFrame) -> DataFrame:
        """The table's columns in their declared types, which readers rely on."""
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(self.schema)])

    def _empty(self) -> DataFrame:
        """No rows, and none that Python workers would be started for; nor is anything joined with them."""
        return self._typed(self.spark.range(0).select(*[F.lit(None).alias(c) for c in self.columns]))

    # -- what is there -------------------------------------------------------------------------------

    def _all(self) -> DataFrame | None:
        """Every change ever appended; None before the first."""
        try:
            reader = self.spark.read.schema(f"{self.schema}, _op STRING, _version BIGINT, _kind STRING, _mark STRING")
            return reader.parquet(f"{self.root}/changes")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def commits(self) -> list[Commit]:
        """All commits, oldest first; a whole state stands behind the change that it has folded."""
        rows = self._all()
        found = [] if rows is None else map(_PARTITION.search, rows.inputFiles())
        return sorted({Commit(int(m[1]), m[2], m[3]) for m in found if m})

    def last_version(self) -> int:
        return max((c.version for c in self.commits()), default=-1)

    def version_of(self, mark: str) -> int:
        """The version under which `mark` is written: that of its own commit if there is one, else a new one above all."""
        commits = self.commits()
        own = [c.version for c in commits if c.mark == _digest(mark)]
        return own[-1] if own else 1 + max((c.version for c in commits), default=-1)

    # -- reading -------------------------------------------------------------------------------------

    def read(self, before: int | None = None) -> DataFrame:
        """The table now, or as it was before version `before`."""
        rows, commits = self._all(), [c for c in self.commits() if before is None or c.version < before]
        if not commits:
            return self._empty()
        last = commits[-1].version
        whole = max((c.version for c in commits if c.kind == WHOLE), default=None)
        changes = [c for c in commits if c.kind == CHANGE and (whole is None or c.version > whole)]
        rows = rows.filter(F.col("_op") != BEGIN)
        base = None if whole is None else rows.filter((F.col("_kind") == WHOLE) & (F.col("_version") == whole)).select(*self.columns)
        if not changes:
            return base
        changed = rows.filter((F.col("_kind") == CHANGE) & F.col("_version").between(changes[0].version, last))
        newest = changed
        if len(changes) > 1:
            by_key = Window.partitionBy(*self.keys).orderBy(F.desc("_version"), F.desc("_mark"))
            newest = changed.withColumn("_age", F.rank().over(by_key)).filter("_age = 1")
        newest = newest.filter(F.col("_op") == PUT).select(*self.columns)
        if base is None:
            return newest
        return base.join(changed.select(*self.keys), list(self.keys), "left_anti").select(*self.columns).unionByName(newest)

    def read_commit(self, mark: str) -> DataFrame:
        """The rows that the commit of `mark` added or replaced."""
        rows = self._all()
        if rows is None:
            return self._empty()
        return rows.filter((F.col("_mark") == _digest(mark)) & (F.col("_op") == PUT)).select(*self.columns)

    # -- writing -------------------------------------------------------------------------------------

    def _append(self, rows: DataFrame, commit: Commit) -> None:
        """Rows with an `_op`, and one of their own that tells of the commit even if there are none."""
        begin = self._typed(self.spark.range(1).select(*[F.lit(None).alias(c) for c in self.columns])).withColumn("_op", F.lit(BEGIN))
        named = rows.unionByName(begin).withColumns(
            {"_version": F.lit(commit.version).cast("bigint"), "_kind": F.lit(commit.kind), "_mark": F.lit(commit.mark)}
        )
        writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_version", "_kind", "_mark")
        writer.option("compression", "zstd").parquet(f"{self.root}/changes")

    def commit(self, rows: DataFrame, mark: str | None = None, deleted: DataFrame | None = None) -> int:
        """Add or replace the keys of `rows`; drop the keys of `deleted`. Returns the version.

        A key both in `rows` and in `deleted` is kept. Without a mark the commit is one of its own.
        """
        mark = uuid.uuid4().hex if mark is None else mark
        change = self._typed(rows).withColumn("_op", F.lit(PUT))
        if deleted is not None:
            types = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
            keys = deleted.select(*[F.col(k).cast(types[k]) for k in self.keys]).distinct()
            gone = keys.join(self._typed(rows).select(*self.keys), list(self.keys), "left_anti").withColumn("_op", F.lit(DELETE))
            change = change.unionByName(gone, allowMissingColumns=True)
        commit = Commit(self.version_of(mark), CHANGE, _digest(mark))
        self._append(change, commit)
        return commit.version

    def replace_all(self, rows: DataFrame, mark: str | None = None) -> int:
        """The table is exactly `rows` from this version on. Returns the version."""
        mark = uuid.uuid4().hex if mark is None else mark
        commit = Commit(self.version_of(mark), WHOLE, _digest(mark))
        self._append(self._typed(rows).withColumn("_op", F.lit(PUT)), commit)
        return commit.version

    def fold(self, share: float = FOLD_SHARE) -> bool:
        """Append the whole table as of now if the changes have `share` of its rows; returns whether it did.

        A single change without a whole state before it is as good as one.
        """
        commits = self.commits()
        whole = max((c.version for c in commits if c.kind == WHOLE), default=None)
        changes = [c for c in commits if c.kind == CHANGE and (whole is None or c.version > whole)]
        if not changes or whole is None and len(changes) == 1:
            return False
        if whole is not None:
            recent = (F.col("_version") > whole) | (F.col("_kind") == WHOLE) & (F.col("_version") == whole)
            sizes = dict(self._all().filter(recent).groupBy("_kind").count().collect())
            if sizes.get(CHANGE, 0) < share * sizes.get(WHOLE, 0):
                return False
        folded = Commit(changes[-1].version, WHOLE, _digest("".join(c.mark for c in changes)))
        self._append(self._typed(self.read(before=folded.version + 1)).withColumn("_op", F.lit(PUT)), folded)
        return True


    def vacuum(self) -> int:
        """Delete what stands before the last whole state. Returns the number of commits deleted, which can't be repeated any more."""
        commits = self.commits()
        whole = max((c.version for c in commits if c.kind == WHOLE), default=-1)
        old = [c for c in commits if c.version < whole or c.version == whole and c.kind == CHANGE]
        for c in old:
            remove_folder(self.spark, f"{self.root}/changes/_version={c.version}/_kind={c.kind}/_mark={c.mark}")
        return len(old)


def _digest(mark: str) -> str:
    return hashlib.sha256(mark.encode()).hexdigest()[:16]
