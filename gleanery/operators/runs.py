"""Look-ups by key in sorted runs.

A run is a Parquet table bucketed by key and sorted within its buckets, one file per bucket. A batch becomes a run; when
there are `fanout` runs of about the same age, they are folded into one, so a table of n batches has about
`fanout` * log(n) runs and each row is folded log(n) times. A look-up leaves the runs where they lie: few keys are
literals, which prune buckets and row groups; many keys are sent to the buckets' tasks and merged there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources import commits

BUCKETS = 32
FANOUT = 4
# Keys up to this many are asked for as literals.
FEW = 500
_KEY = "run_key"


def _span(attempt: commits.Attempt) -> tuple[int, int]:
    first, last = attempt.writer.removeprefix("run-").split("-")
    return int(first), int(last)


class KeyRuns:
    """Rows of `schema` by their `keys`; of rows with the same key, the one with the greatest `order` counts, and of equal
    ones that of the later batch. Batches are numbered from 0 by their one writer; a batch that is written again replaces
    itself unless it was folded already."""

    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], order: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.keys, self.order, self.buckets, self.fanout = keys, order, buckets, fanout

    def _key(self) -> Column:
        # Lengths go ahead, so that no two keys have one text; null is unlike any text.
        parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(k).cast("string") for k in self.keys)]
        return F.concat(*parts)

    def _runs(self) -> list[commits.Attempt]:
        """The committed runs that no other run holds, oldest first. Folding is one commit, so readers see either all of the
        folded ones or what became of them."""
        found = commits.committed(self.spark, self.root)
        spans = {a: _span(a) for a in found}

        def held(a):
            x, y = spans[a]
            return any(b is not a and p <= x and y <= q and (q - p) > (y - x) for b, (p, q) in spans.items())

        return sorted((a for a in found if not held(a)), key=lambda a: spans[a])

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        attempt = commits.new_attempt(self.root, first, f"run-{first}-{last}")
        name = f"run_{uuid.uuid4().hex}"
        # As many partitions as buckets, by the same hash: every task writes the one file of its bucket.
        out = rows.repartition(self.buckets, _KEY).write.format("parquet")
        try:
            out.bucketBy(self.buckets, _KEY).sortBy(_KEY).option("path", attempt.path).saveAsTable(name)
        except BaseException:
            commits.abort(self.spark, attempt)
            raise
        finally:
            # The files are outside of the warehouse and stay.
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        commits.commit(self.spark, attempt)

    def _fold(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (_KEY, "batch")]
        newest = F.max_by(F.struct("batch", *rest), F.struct(F.col(self.order).isNotNull(), self.order, "batch"))
        return rows.groupBy(_KEY).agg(newest.alias("__v")).select(_KEY, "__v.*")

    def store(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch, folded to one row per key, and folds runs if there are enough of them."""
        named = rows.select(*self.schema.fieldNames()).withColumns({_KEY: self._key(), "batch": F.lit(int(batch)).cast("long")})
        self._write(self._fold(named), batch, batch)
        self.compact()

    def compact(self) -> None:
        """Folds the newest runs for as long as the last `fanout` of them are about as large as each other."""
        while True:
            runs = self._runs()
            last = runs[-self.fanout :]
            sizes = [_span(a)[1] - _span(a)[0] + 1 for a in last]
            if len(last) < self.fanout or max(sizes) > min(sizes):
                return
            folded = self._fold(self._union(last))
            self._write(folded, _span(last[0])[0], _span(last[-1])[1])

    def _fields(self) -> T.StructType:
        return T.StructType([T.StructField(_KEY, T.StringType()), T.StructField("batch", T.LongType()), *self.schema.fields])

    def _table(self, run: commits.Attempt) -> DataFrame:
        """A run as a bucketed table."""
        name = f"run_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._fields())
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({_KEY}) SORTED BY ({_KEY}) INTO {self.buckets} BUCKETS LOCATION '{run.path}'"
        )
        # The name is needed to tell Spark of the buckets, and no longer than that.
        found = self.spark.table(name)
        found.schema  # noqa: B018  analysed while the name is there
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def _union(self, runs: list[commits.Attempt]) -> DataFrame:
        """Whole runs as plain files. Not as bucketed tables: Spark 4.1 takes their union for partitioned by key, and then may
        read them without their buckets, which left keys unfolded."""
        return self.spark.read.schema(self._fields()).parquet(*(r.path for r in runs))

    def read(self) -> DataFrame:
        """The row that counts of every key."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._fold(self._union(runs)).select(*self.schema.fieldNames())

    def get(self, requests: DataFrame) -> DataFrame:
        """Each row of `requests` with `found` and, if so, the columns of the row with its keys (not the keys again).

        Distinct keys are asked for once, so a key that many requests name costs one row per run.
        """
        values = [c for c in self.schema.fieldNames() if c not in self.keys]
        if clash := [c for c in (*values, "found", _KEY) if c in requests.columns]:
            raise ValueError(f"requests have columns of the table: {clash}")
        asked = requests.withColumn(_KEY, self._key())
        runs = self._runs()
        if not runs:
            none = [F.lit(None).cast(self.schema[c].dataType).alias(c) for c in values]
            return requests.select("*", F.lit(False).alias("found"), *none)
        distinct = asked.select(_KEY).distinct()
        some = [r[0] for r in distinct.limit(FEW + 1).collect()]
        found = None
        for run in runs:
            table = self._table(run)
            if len(some) <= FEW:
                hit = table.filter(F.col(_KEY).isin(some))
            else:
                # Sorted buckets on one side, the keys sent to their buckets on the other.
                hit = table.join(distinct.hint("merge"), _KEY, "left_semi")
            # Fewer partitions, though they are as many: what comes after must not count on buckets (see `_union`).
            hit = hit.coalesce(max(2, self.buckets))
            found = hit if found is None else found.unionByName(hit)
        hits = self._fold(found).select(_KEY, F.lit(True).alias("found"), *values)
        joined = asked.join(hits, _KEY, "left").drop(_KEY)
        return joined.withColumn("found", F.coalesce("found", F.lit(False)))
