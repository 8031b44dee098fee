"""A log of entries in Parquet, shard by shard: fence, append, read, trim.

Entries are files that are never changed. What happened to a shard is a chain of numbered
records (records.py): a fence, an append with its file and positions, a trim, a compaction.
Each record also says what then holds (owner, next position, trim), so a writer reads one
record, however long the log is, and an append costs what it appends. Of two writers that
publish the same number one wins, and the other judges its request anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import Records

ENTRY = "shard long, seqno long, epoch long, payload string"
FIRST = 1


class Refused(Exception):
    """An append or fence that the log doesn't take."""


class BadRequest(Refused, ValueError):
    """Refused before the log is looked at."""


class Fenced(Refused):
    """Another epoch owns the shard, or none does. Outranks the others: a displaced writer
    must not take its successor's entry for its own."""


class AlreadyWritten(Refused):
    pass


class Gap(Refused):
    pass


class ParquetLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._records: dict[int, Records] = {}

    # ---- what holds ------------------------------------------------------------------

    def _of(self, shard: int) -> Records:
        if shard not in self._records:
            self._records[shard] = Records(self.spark, f"{self.folder}/records/shard={shard}")
        return self._records[shard]

    def _state(self, shard: int) -> tuple[int, dict]:
        records = self._of(shard)
        at = records.last()
        return at, records.read(at) if at else {"owner": 0, "next": FIRST, "trimmed": 0}

    def owner(self, shard: int) -> int:
        return self._state(shard)[1]["owner"]

    def next_seqno(self, shard: int) -> int:
        return self._state(shard)[1]["next"]

    def shards(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/records")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at)) if fs.exists(at) else []

    # ---- writing ---------------------------------------------------------------------

    def fence(self, shard: int, epoch: int) -> None:
        """Claims a shard and cuts off lower epochs; an equal epoch again does nothing.
        Entries stay, and the new owner goes on at the next position."""
        if epoch < 1:
            raise BadRequest(f"fencing shard {shard}: zero epoch")
        while True:
            at, held = self._state(shard)
            if held["owner"] > epoch:
                raise Fenced(f"shard {shard} is fenced at epoch {held['owner']}, cannot fence at {epoch}")
            if held["owner"] == epoch or self._of(shard).publish(at + 1, self._next(held, what="fence", owner=epoch)):
                return

    @staticmethod
    def _next(held: dict, **new) -> dict:
        return {k: held[k] for k in ("owner", "next", "trimmed")} | new

    def _refusal(self, shard: int, epoch: int, seqno: int, held: dict) -> Refused | None:
        if held["owner"] == 0:
            return Fenced(f"shard {shard} is not fenced, cannot append at epoch {epoch}")
        if held["owner"] != epoch:
            return Fenced(f"shard {shard} is fenced at epoch {held['owner']}, cannot append at {epoch}")
        if seqno < held["next"]:
            return AlreadyWritten(f"seqno {seqno} of shard {shard} is taken: already written")
        if seqno > held["next"]:
            return Gap(f"gap: shard {shard} has no seqno {seqno - 1}, cannot append at {seqno}")
        return None

    def append(self, shard: int, epoch: int, seqno: int, payload: str | None) -> None:
        """Writes one entry."""
        if epoch < 1:
            raise BadRequest(f"appending to shard {shard}: zero epoch")
        if seqno < FIRST:
            raise BadRequest(f"appending to shard {shard}: seqno {seqno} is below the first seqno {FIRST}")
        if payload is None:
            raise BadRequest(f"appending to shard {shard} at seqno {seqno}: the payload is null")
        if refusal := self._refusal(shard, epoch, seqno, self._state(shard)[1]):
            raise refusal
        self._write(epoch, self.spark.createDataFrame([(shard, seqno, payload)], "shard long, seqno long, payload string"), {shard: (seqno, seqno)})

    def append_batch(self, epochs: dict[int, int], new: DataFrame, batch: int) -> list[int]:
        """Appends entries (shard, seqno, payload) that go on gap-free in each shard, as the
        owner of each by `epochs`. A shard takes all of its entries or none; all shards are
        judged before any entry is written. Returns the shards that took theirs now: those
        whose last append was this batch, or a later one, have it already."""
        found = new.groupBy("shard").agg(
            F.min("seqno").alias("first"),
            F.max("seqno").alias("last"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("payload").isNull()).alias("nulls"),
            F.countDistinct("seqno").alias("kinds"),
        )
        spans = {}
        for r in found.orderBy("shard").collect():  # a row for each shard that is written to
            shard, epoch = r["shard"], epochs.get(r["shard"], 0)
            held = self._state(shard)[1]
            if held.get("batch", -1) >= batch and held["owner"] == epoch:
                continue
            if epoch < 1:
                raise BadRequest(f"appending to shard {shard}: zero epoch")
            if r["nulls"] or r["first"] < FIRST:
                raise BadRequest(f"appending to shard {shard}: " + ("the payload is null" if r["nulls"] else f"seqno {r['first']} is below the first seqno"))
            if refusal := self._refusal(shard, epoch, r["first"], held):
                raise refusal
            if r["kinds"] < r["n"]:
                raise AlreadyWritten(f"shard {shard}: a seqno comes twice: already written")
            if r["last"] - r["first"] + 1 != r["n"]:
                raise Gap(f"gap: the entries of shard {shard} from {r['first']} to {r['last']} are not all there")
            spans[shard] = (r["first"], r["last"])
        if spans:
            rows = new.filter(F.col("shard").isin(list(spans))).select("shard", "seqno", "payload")
            self._write(epochs, rows, spans, batch)
        return list(spans)

    def _write(self, epoch, rows: DataFrame, spans: dict[int, tuple[int, int]], batch: int | None = None) -> None:
        folder = f"{self.folder}/entries/{uuid.uuid4().hex}"
        rows.withColumn("s", F.col("shard")).repartition("shard").sortWithinPartitions("shard", "seqno").write.partitionBy("s").parquet(folder)
        for shard, (first, last) in spans.items():
            mine = epoch[shard] if isinstance(epoch, dict) else epoch
            more = {} if batch is None else {"batch": batch}
            while True:
                at, held = self._state(shard)
                if refusal := self._refusal(shard, mine, first, held):
                    raise refusal
                record = self._next(held, what="append", file=f"{folder}/s={shard}", first=first, last=last, epoch=mine, **more)
                if self._of(shard).publish(at + 1, record | {"next": last + 1}):
                    break

    def trim(self, shard: int, up_to: int) -> bool:
        """Deletes a shard's entries up to a position; their numbers stay spent. Takes no
        epoch: the caller sees to it that what is trimmed is at rest."""
        while up_to >= FIRST:
            at, held = self._state(shard)
            up_to = min(up_to, held["next"] - 1)
            if up_to <= held["trimmed"]:
                return False
            if self._of(shard).publish(at + 1, self._next(held, what="trim", trimmed=up_to)):
                return True
        return False

    def compact(self, shard: int) -> None:
        """Puts a shard's entries into one file and starts its chain of records anew."""
        folder = f"{self.folder}/entries/{uuid.uuid4().hex}"
        while True:
            at, held = self._state(shard)
            self.entries(shard).select("shard", "seqno", "payload", F.col("epoch").alias("at_epoch"), F.col("shard").alias("s")).repartition(1).sortWithinPartitions(
                "seqno"
            ).write.mode("overwrite").partitionBy("s").parquet(folder)
            whole = {"file": f"{folder}/s={shard}", "first": held["trimmed"] + 1, "last": held["next"] - 1}
            if self._of(shard).publish(at + 1, self._next(held, what="compact", **whole)):
                break
        self._of(shard).forget(at + 1)

    def pressure(self, drain_below: int, stop_below: int) -> int:
        """How urgently the store wants space back, by the bytes that it has left: 0 not at
        all, 1 drain and trim now, 2 also refuse writes. What was acknowledged stays so."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        left = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getStatus().getRemaining()
        return 2 if left < stop_below else 1 if left < drain_below else 0

    def close(self) -> None:
        """Lets go of what this writer remembers; entries and owners stay."""
        self._records.clear()

    # ---- reading ---------------------------------------------------------------------

    def _files(self, shard: int) -> tuple[list[dict], int]:
        """The appends that hold a shard's entries, and up to where it is trimmed."""
        records = self._of(shard)
        found, trimmed = [], 0
        for number in reversed(records.numbers()):
            record = records.read(number)
            trimmed = max(trimmed, record["trimmed"])
            if record["what"] in ("append", "compact") and record["last"] > trimmed:
                found.append(record)
            if record["what"] == "compact":
                break
        return found, trimmed

    def entries(self, *shards: int) -> DataFrame:
        """shard, seqno, epoch, payload of some shards, or of all."""
        out = self.spark.createDataFrame([], ENTRY)
        schema = "shard long, seqno long, payload string, at_epoch long"
        for shard in shards or self.shards():
            files, trimmed = self._files(shard)
            by_epoch: dict = {}
            for f in files:
                by_epoch.setdefault(f.get("epoch"), []).append(f["file"])
            for epoch, paths in by_epoch.items():
                rows = self.spark.read.schema(schema).parquet(*paths).filter(F.col("seqno") > trimmed)
                held = F.col("at_epoch") if epoch is None else F.lit(epoch).cast("long")
                out = out.unionByName(rows.select("shard", "seqno", held.alias("epoch"), "payload"))
        return out

    def read_from(self, shard: int, start: int, limit: int) -> DataFrame:
        """At most `limit` entries from a position on, in order; fewer mean the log's end."""
        if limit <= 0:
            raise BadRequest(f"reading shard {shard} from {start}: limit {limit} is not positive")
        return self.entries(shard).filter(F.col("seqno") >= max(start, FIRST)).orderBy("seqno").limit(limit)

    def entry_at(self, shard: int, seqno: int) -> str:
        found = self.entries(shard).filter(F.col("seqno") == seqno).first()
        if found is None:
            raise KeyError(f"shard {shard} has no entry at {seqno}")
        return found["payload"]

    def pages(self, shard: int, start: int, page: int, read=None) -> Iterator[list]:
        """All entries from a position on, page by page, until a page that isn't full. A full
        page that doesn't get on is an error. read: in place of read_from, collected."""
        read = read or (lambda *at: self.read_from(*at).collect())
        start = max(start, FIRST)
        while True:
            rows = read(shard, start, page)
            if rows:
                yield rows
            if len(rows) < page:
                return
            if rows[-1]["seqno"] < start:
                raise RuntimeError(f"shard {shard}: a page from {start} ends at {rows[-1]['seqno']}")
            start = rows[-1]["seqno"] + 1


def acknowledged(log: DataFrame, acked: DataFrame) -> DataFrame:
    """What an audit of acknowledged appends (shard, seqno, payload) against the log finds, by
    shard: acked but lost, held with another payload, held but never acknowledged, numbers
    that are missing below the last."""
    both = acked.select("shard", "seqno", F.col("payload").alias("want")).join(log.select("shard", "seqno", F.col("payload").alias("have")), ["shard", "seqno"], "full_outer")
    some = lambda c: F.count_if(c).cast("long")
    return both.groupBy("shard").agg(
        some(F.col("have").isNull()).alias("lost"),
        some(F.col("have") != F.col("want")).alias("other"),
        some(F.col("want").isNull()).alias("unacknowledged"),
        (F.max("seqno") - F.min("seqno") + 1 - F.count(F.lit(1))).cast("long").alias("missing"),
    )
