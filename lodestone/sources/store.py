"""A document store on Parquet: insert, replace by file, conditional update, delete, aliases, ad-hoc SQL."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .durable import durable

MOST_ROWS = 1000


#: Parts of a table, by a hash of the file key: a write makes those anew that it touches.
BUCKETS = 16
_BUCKET = "store_bucket"


class Store:
    """Versioned snapshots of one table under a folder; the highest finished file ``CURRENT-<number>`` names the live one.

    A snapshot is a manifest, which lists a folder for each bucket. A write makes new folders for the buckets that it touches,
    a new manifest over these and the old ones, and then a pointer of the next number. A pointer is one file made by exclusive
    creation: of two writers that move the same pointer one fails and changes nothing. Its last line marks it as finished;
    readers pass over one that is not, so they see the old or the new state."""

    def __init__(self, spark: SparkSession, folder: str, key: str, file_key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.file_key, self.buckets = spark, folder.rstrip("/"), key, file_key, buckets

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, lines: list[str]) -> None:
        """A new file of the folder; fails if there is one of the name."""
        jvm, fs = self._files()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), False)
        out.write(bytearray("\n".join([*lines, "end"]).encode()))
        out.close()

    def _lines(self, name: str) -> list[str] | None:
        """The lines of a file, or None if it is not finished."""
        jvm, fs = self._files()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"))
        *lines, last = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        return lines if last == "end" else None

    def _latest(self) -> tuple[int, str | None]:
        """The highest number of a pointer, and the name of the live snapshot."""
        jvm, fs = self._files()
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT-*"))
        names = sorted((s.getPath().getName() for s in found or []), reverse=True)
        live = next((lines[0] for lines in map(self._lines, names) if lines), None)
        return (int(names[0].split("-")[1]) if names else 0), live

    def _pointer(self) -> str | None:
        return self._latest()[1]

    def _manifest(self, name: str | None) -> tuple[str | None, dict[int, str]]:
        """The schema of a snapshot, and the folder of each bucket that has rows."""
        if name is None:
            return None, {}
        schema, *parts = self._lines(f"manifest-{name}")
        return schema, {int(b): folder for b, folder in (p.split(" ") for p in parts)}

    def _open(self, schema: str, folders: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(f"{self.folder}/{f}" for f in sorted(folders))) if folders else self.spark.createDataFrame([], kind)

    def read(self) -> DataFrame:
        schema, parts = self._manifest(self._pointer())
        if schema is None:
            raise RuntimeError("the store has no snapshot yet")
        return self._open(schema, list(parts.values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.file_key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket()).distinct().collect()}  # BUCKETS at most

    def _publish(self, touched: set[int], change) -> str:
        """A snapshot with ``change(rows of the touched buckets)`` in place of these; it is moved to if nobody else has moved on."""
        number, before = self._latest()
        schema, parts = self._manifest(before)
        old = None if schema is None else self._open(schema, [f for b, f in parts.items() if b in touched])
        new = change(old)
        folder, name = f"data-{uuid.uuid4().hex}", f"v-{uuid.uuid4().hex}"
        new.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{folder}")
        jvm, fs = self._files()
        made = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}/{_BUCKET}=*"))
        names = [s.getPath().getName() for s in made or []]
        now = {b: f for b, f in parts.items() if b not in touched} | {int(n.split("=")[1]): f"{folder}/{n}" for n in names}
        self._create(f"manifest-{name}", [new.schema.json(), *(f"{b} {f}" for b, f in sorted(now.items()))])
        self._move(number + 1, name)
        return name

    def _move(self, number: int, name: str) -> None:
        try:
            self._create(f"CURRENT-{number:012d}", [name])
        except Py4JJavaError as e:
            raise RuntimeError("another writer moved the pointer") from e

    def switch(self, name: str, expected: str | None = None) -> str | None:
        """Point readers to a snapshot; returns the former one, to restore. With ``expected``, only if that is the live one."""
        number, before = self._latest()
        if expected is not None and before != expected:
            raise RuntimeError(f"the live snapshot is {before}, not {expected}")
        self._move(number + 1, name)
        return before

    def insert(self, rows: DataFrame) -> int:
        """Add rows and check that as many arrived."""
        n = rows.count()
        before = self.read().count() if self._pointer() else 0
        self._publish(self._touched(rows), lambda old: rows if old is None else old.unionByName(rows))
        if self.read().count() != before + n:
            raise RuntimeError("row count after insert differs")
        return n

    def upsert(self, rows: DataFrame) -> None:
        """Rows take the place of those of their keys, in whatever file these were."""
        keys = rows.select(self.key).distinct()
        touched = self._touched(rows) | self._touched(self.read().join(keys, self.key, "left_semi"))
        self._publish(touched, lambda old: old.join(keys, self.key, "left_anti").unionByName(rows))

    def replace_files(self, rows: DataFrame) -> None:
        """Delete all rows of the files that the new rows belong to, then insert."""
        self._publish(self._touched(rows), lambda old: old.join(rows.select(self.file_key).distinct(), self.file_key, "left_anti").unionByName(rows))

    def update(self, where: Column, changes: dict[str, Column]) -> None:
        """The file key of a row must not change."""
        hit = F.coalesce(where, F.lit(False))
        self._publish(self._touched(self.read().filter(hit)), lambda old: old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}))

    def delete(self, where: Column) -> None:
        hit = F.coalesce(where, F.lit(False))
        self._publish(self._touched(self.read().filter(hit)), lambda old: old.filter(~hit))


def reconcile(store: Store, snapshot: Callable[[], DataFrame], version: str, most: int = 3) -> tuple[int, bool]:
    """Bring a store to what ``snapshot()`` says now: rows that are missing or of another ``version`` are written, those that are gone
    deleted, and the snapshot is taken again, as it may have changed meanwhile, until no difference is left; ``most`` passes at most.

    Returns the number of passes that changed something, and whether the last look found no difference."""
    for done in range(most + 1):
        wanted, held = snapshot(), store.read()
        same = (F.col("w._v").eqNullSafe(F.col("h._v"))) & F.col("w._k").isNotNull() & F.col("h._k").isNotNull()
        side = lambda df: df.select(F.col(store.key).alias("_k"), F.col(version).alias("_v"))
        differ = side(wanted).alias("w").join(side(held).alias("h"), F.col("w._k") == F.col("h._k"), "full_outer").filter(~F.coalesce(same, F.lit(False)))
        ids = durable(differ.select(F.coalesce("w._k", "h._k").alias(store.key), F.col("w._k").isNull().alias("_gone")), "differences")
        if ids.isEmpty():
            return done, True
        if done == most:
            return done, False
        fresh = wanted.join(ids.filter("not _gone").select(store.key), store.key, "left_semi")
        touched = store._touched(fresh) | store._touched(held.join(ids.select(store.key), store.key, "left_semi"))
        store._publish(touched, lambda old: old.join(ids.select(store.key), store.key, "left_anti").unionByName(fresh))  # noqa: B023

def adjust_pagerank(c: Column, change: Column) -> Column:
    """Add to a weight, keep it within 0..100, none at 0."""
    return F.nullif(F.least(F.greatest(F.coalesce(c, F.lit(0)) + change, F.lit(0)), F.lit(100)), F.lit(0))


#: A condition on a column of tokens, and the share of its words that must be met.
_TOKEN_CONDITION, _MATCH_SHARE = re.compile(r" ([a-z_]+_l?tks)( like | ?= ?)'([^']+)'"), 0.3


def rewrite_token_conditions(sql: str) -> str:
    """Conditions ``x_tks like '...'`` and ``x_tks = '...'`` as matches: three tenths of the words (one at least) stand in the column.
    Per cents and repeated blanks go, as in the dialect that such texts are written for."""

    def match(m: re.Match) -> str:
        words = list(dict.fromkeys(re.findall(r"\w+", m[3].lower())))
        need = max(1, int(_MATCH_SHARE * len(words)))
        listed = ", ".join(f"'{w}'" for w in words)
        return f" size(array_intersect(split(lower({m[1]}), ' '), array({listed}))) >= {need} "

    return _TOKEN_CONDITION.sub(match, re.sub(r"[ `]+", " ", sql).replace("%", ""))


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int | None = MOST_ROWS) -> DataFrame:
    """Ad-hoc SQL over DataFrames as named views ({name} in the text); a limit is set unless the text has one."""
    text = sql.rstrip().rstrip(";")
    if limit and " limit " not in text.lower():
        text += f" limit {int(limit)}"
    return spark.sql(text, **tables)
