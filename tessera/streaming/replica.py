"""A keyed table that batches are merged into, pulls by a kept cursor, and pushes out of an outbox stream.

A replica is a folder with one part for each batch, dealt by a hash of the key; the row of a key is that of its latest batch. A batch is
merged against what the batches before it left, and overwrites its own part only. So a batch that is run again, after a failure or a lost
driver, gives the same table, and costs what it touches: its own rows, and of the table the buckets of its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.replication import coalesced, merged

#: fixed values: seconds that clocks may differ by, pages of one pull
SKEW_SECONDS, MOST_PAGES = 2, 100
_COLUMNS = ("id", "updated_at", "verified", "deleted_at")


@dataclass(frozen=True)
class Replica:
    """Rows with the columns of ``schema``, among them id, updated_at, verified and deleted_at, below ``path``, which all executors share."""

    spark: SparkSession
    path: str
    schema: StructType
    buckets: int = 64

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("long")

    def _part(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}/batch={number}"

    def _read(self, kind: str, schema: StructType) -> DataFrame:
        start = self.spark.createDataFrame([], schema).write.mode("overwrite")  # so that the folder exists
        (start.partitionBy("bucket") if "bucket" in schema.names else start).parquet(self._part(kind, -1))
        return self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{self.path}/{kind}")

    def rows(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The table as the batches before ``before`` left it; with ``touched(id)``, only what those keys need.

        Which buckets they lie in is read first (at most ``buckets`` numbers), so whole folders are left out of the scan.
        """
        held = self._read("rows", StructType([*self.schema.fields, StructField("bucket", LongType())]))
        if before is not None:
            held = held.where(F.col("batch") < before)
        if touched is not None:
            own = [r[0] for r in touched.select(self._bucket(F.col("id"))).distinct().collect()]
            held = held.where(F.col("bucket").isin(own)).join(touched.select("id").distinct(), "id", "left_semi")
        latest = held.groupBy("id").agg(F.max_by(F.struct(*(c for c in self.schema.names if c != "id")), "batch").alias("x"))
        return latest.select("id", "x.*").select(*self.schema.names)

    def upsert(self, number: int, incoming: DataFrame) -> DataFrame:
        """Merge ``incoming``, one row for each id, as batch ``number``; the (id, action, audited) of each row, as written.

        Rows without id go. The resolver compares each row with the table's: newer wins, verified rows and deletions have their own rules.
        """
        new = incoming.select(*self.schema.names).where("id is not null")
        judged = merged(self.rows(number, new), new)
        judged.write.mode("overwrite").parquet(self._part("outcomes", number))
        outcome = self.spark.read.schema(judged.schema).parquet(self._part("outcomes", number))
        wins = new.join(outcome.where("action <> 'skip'").select("id"), "id", "left_semi")
        wins.select(*self.schema.names, self._bucket(F.col("id")).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._part("rows", number))
        return outcome

    def cursor(self) -> tuple[int, int | None]:
        """Number of the last whole batch and its cursor in microseconds; (-1, None) before the first."""
        found = self._read("cursor", StructType([StructField("at", LongType())])).where("batch >= 0")
        last = found.orderBy(F.desc("batch")).first()
        return (int(last["batch"]), last["at"]) if last else (-1, None)

    def move_cursor(self, number: int, at: int) -> None:
        self.spark.createDataFrame([(at,)], "at long").coalesce(1).write.mode("overwrite").parquet(self._part("cursor", number))


def bootstrap(replica: Replica, remote: DataFrame, now_micros: int) -> DataFrame:
    """Merge all of ``remote`` as the first batch; the cursor is put at now less the clocks' skew, so what lands meanwhile is pulled later."""
    number = replica.cursor()[0] + 1
    outcome = replica.upsert(number, remote)
    replica.move_cursor(number, now_micros - SKEW_SECONDS * 1_000_000)
    return outcome


def pull(replica: Replica, remote: DataFrame, now_micros: int, page_rows: int = 500, most_pages: int = MOST_PAGES, fail_after: int | None = None) -> dict:
    """Merge what changed in ``remote`` since the cursor, page by page to the end or ``most_pages``; counts by action.

    A page is the oldest ``page_rows`` changes and all that share the last one's time, so a cursor never cuts equal times apart. The cursor moves once a page
    is whole: a pull that broke off repeats its open page as the same batch. ``fail_after`` breaks off after so many pages, for tests.
    """
    number, at = replica.cursor()
    if at is None:
        raise ValueError("no cursor yet: bootstrap first")
    time = F.unix_micros("updated_at")
    counts: dict[str, int] = {"fetched": 0, "pages": 0}
    for page in range(most_pages):
        open_ = remote.where((time > at) & (time <= now_micros - SKEW_SECONDS * 1_000_000))
        edge = open_.select(time.alias("t")).orderBy("t").limit(page_rows).agg(F.max("t"), F.count("*")).first()
        if edge[0] is None:
            break
        outcome = replica.upsert(number + 1, open_.where(time <= edge[0]))
        if fail_after == page:
            raise RuntimeError("broken off before the cursor moved")
        number, at = number + 1, int(edge[0])
        replica.move_cursor(number, at)
        for r in outcome.groupBy(F.when(F.col("audited"), "conflict").otherwise(F.col("action")).alias("a")).count().collect():
            counts[r[0]] = counts.get(r[0], 0) + r[1]
            counts["fetched"] += r[1]
        counts["pages"] += 1
        if edge[1] < page_rows:
            break
    return counts | {"cursor": at}


def push_batch(replica: Replica, number: int, outbox: DataFrame) -> DataFrame:
    """Push one batch of ``outbox(id, entry_id, row_payload, attempts, created_at)``; (id, entry_id, status, attempts) of every row, as written.

    Of each entry the latest row is pushed and the older ones share its fate: confirmed once it is merged (whichever side won), released without a
    further attempt if its payload cannot be read.
    """
    payload = F.from_json("row_payload", replica.schema, {"mode": "PERMISSIVE"})
    latest = coalesced(outbox.select("id", "entry_id", "row_payload", "created_at")).select("entry_id", F.when(F.try_parse_json("row_payload").isNotNull(), payload).alias("x"))
    latest.select("entry_id", "x").write.mode("overwrite").parquet(f"{replica.path}/payloads/batch={number}")
    read = replica.spark.read.schema(latest.schema).parquet(f"{replica.path}/payloads/batch={number}")
    sound = read.where((F.col("x.id") == F.col("entry_id")) & F.col("x.updated_at").isNotNull())
    replica.upsert(number, sound.select("x.*").withColumn("verified", F.coalesce("verified", F.lit(False))))
    status = outbox.join(sound.select("entry_id", F.lit("confirmed").alias("status")), "entry_id", "left").select("id", "entry_id", F.coalesce("status", F.lit("released")).alias("status"), "attempts")
    status.write.mode("overwrite").parquet(f"{replica.path}/status/batch={number}")
    return replica.spark.read.schema(status.schema).parquet(f"{replica.path}/status/batch={number}")


def push_stream(replica: Replica, outbox: DataFrame, checkpoint: str):
    """Push an outbox stream to its end, a micro-batch at a time; a batch that is replayed gives the same table and the same status."""
    return outbox.writeStream.foreachBatch(lambda rows, number: push_batch(replica, number, rows) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
