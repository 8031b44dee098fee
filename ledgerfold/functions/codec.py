"""The record codec: one mutation as one deterministic JSON document, and what it refuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1
#: The arms of a record; exactly one is set.
ARMS = ("create", "update", "conflict_resolve", "set", "delete", "delete_current", "add_tasks", "range_complete")

_KEYED = "array<struct<key:bigint,value:double>>"
_PART = f"struct<run:bigint,version:bigint,upserts:{_KEYED},deletes:array<bigint>>"
_TASKS = "array<struct<category:bigint,fire_us:bigint,task_id:bigint>>"
_EVENTS = "array<struct<branch:bigint,node:bigint,txn:bigint,events:string>>"
#: What each arm holds, in order: parts are whole states of runs or changes to them.
_ARM = {
    "create": f"struct<workflow:bigint,parts:array<{_PART}>,tasks:{_TASKS},events:{_EVENTS}>",
    "update": f"struct<workflow:bigint,parts:array<{_PART}>,tasks:{_TASKS},events:{_EVENTS}>",
    "conflict_resolve": f"struct<workflow:bigint,parts:array<{_PART}>,tasks:{_TASKS},events:{_EVENTS}>",
    "set": f"struct<workflow:bigint,parts:array<{_PART}>,tasks:{_TASKS}>",
    "delete": "struct<workflow:bigint,run:bigint>",
    "delete_current": "struct<workflow:bigint,run:bigint>",
    "add_tasks": f"struct<workflow:bigint,run:bigint,tasks:{_TASKS}>",
    "range_complete": "struct<ranges:array<struct<category:bigint,lo:bigint,hi:bigint>>>",
}
RECORD = "format int, provisional boolean, shard bigint, " + ", ".join(f"`{a}` {_ARM[a]}" for a in ARMS)
#: Categories of tasks: immediate (1) and scheduled (2).
CATEGORIES = (1, 2)


def kind_of(arms: dict[str, Column]) -> Column:
    """The arm that is set; null unless exactly one is."""
    n = sum((c.isNotNull().cast("int") for c in arms.values()), F.lit(0))
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(a)) for a, c in arms.items()))
    return F.when(n == 1, name)


def encode(entries: DataFrame) -> DataFrame:
    """shard, seqno and payload of a log's entries: JSON with fields in the record's order
    and keyed entries sorted, so equal mutations have equal bytes. A null field is left out."""
    c = F.col
    one = lambda holds, value: F.array_compact(F.array(F.when(holds, value)))
    upserts = F.array_sort(one(c("op") == "U", F.struct("key", "value")))
    deletes = F.array_sort(one(c("op") == "D", c("key")))
    part = F.array(F.struct("run", "version", upserts.alias("upserts"), deletes.alias("deletes")))
    no_tasks, tick = F.array().cast(_TASKS), c("k") % 2 == 0
    task = lambda category, at: F.struct(F.lit(category).cast("long").alias("category"), at.alias("fire_us"), c("seqno").alias("task_id"))
    scheduled = F.unix_micros(c("ts") + F.make_dt_interval(mins=c("k").cast("int")))
    tasks = F.array_compact(F.array(task(1, F.lit(None).cast("long")), F.when(tick, task(2, scheduled))))
    event = F.struct((c("run") % 2).alias("branch"), c("version").alias("node"), c("seqno").alias("txn"), F.concat(F.lit("e"), c("k").cast("string")).alias("events"))
    ranges = F.array(F.struct(F.lit(1).cast("long").alias("category"), (c("seqno") - 64).alias("lo"), c("seqno").alias("hi")))
    arms = {
        "update": F.struct("workflow", part.alias("parts"), no_tasks.alias("tasks"), one(c("k") % 5 == 0, event).alias("events")),
        "set": F.struct("workflow", part.alias("parts"), no_tasks.alias("tasks")),
        "delete": F.struct("workflow", "run"),
        "add_tasks": F.struct("workflow", "run", tasks.alias("tasks")),
        "range_complete": F.struct(ranges.alias("ranges")),
    }
    kind = F.when(c("kind") == "snapshot", "set").otherwise(c("kind"))
    record = F.struct(
        F.lit(FORMAT).alias("format"),
        (c("epoch") < c("owner")).alias("provisional"),
        "shard",
        *(F.when(kind == a, arms[a]).alias(a) for a in ARMS if a in arms),
    )
    return entries.select("shard", "seqno", F.to_json(record).alias("payload"))


def _fields(kind: T.DataType, at: str) -> list[tuple[str, list[str]]]:
    """The JSON paths of a record's objects that aren't in lists, with the fields they may have."""
    out = [(at, kind.fieldNames())]
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            out += _fields(f.dataType, f"{at}.{f.name}")
    return out


def decode(payloads: DataFrame) -> DataFrame:
    """shard, seqno, reason (why a payload is refused, else null), kind and the record's fields."""
    parsed = payloads.withColumn("r", F.from_json("payload", RECORD, {"mode": "PERMISSIVE"}))
    unknown = F.lit(False)
    for at, names in _fields(T.StructType.fromDDL(RECORD), "$"):
        keys = F.json_object_keys(F.get_json_object("payload", at))
        unknown |= F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) > 0, F.lit(False))
    arms = {a: F.col(f"r.{a}") for a in ARMS}
    kind = kind_of(arms)
    twice = F.lit(False)
    for a in ARMS:
        if "parts" in _ARM[a]:  # within a part, no key is written twice, nor written and deleted
            keys = lambda p: F.concat(F.transform(p["upserts"], lambda u: u["key"]), p["deletes"])
            twice |= F.coalesce(F.exists(f"r.{a}.parts", lambda p: F.size(keys(p)) != F.size(F.array_distinct(keys(p)))), F.lit(False))
    odd = F.lit(False)
    for a in ARMS:
        for field in ("tasks", "ranges"):
            if f"{field}:" in _ARM[a]:
                odd |= F.coalesce(F.exists(f"r.{a}.{field}", lambda x: ~F.coalesce(x["category"].isin(*CATEGORIES), F.lit(False))), F.lit(False))
    n_arms = sum((c.isNotNull().cast("int") for c in arms.values()), F.lit(0))
    reason = (
        F.when(F.json_object_keys("payload").isNull(), "malformed")
        .when(F.col("r.format").isNull() | (F.col("r.format") != FORMAT), "other format")
        .when(unknown, "unknown field")
        .when(n_arms == 0, "no request")
        .when(n_arms > 1, "several requests")
        .when(twice, "duplicate key")
        .when(odd, "unknown category")
    )
    return parsed.select("shard", "seqno", reason.alias("reason"), kind.alias("kind"), "r.format", "r.provisional", F.col("r.shard").alias("of_shard"), *(F.col(f"r.{a}").alias(a) for a in ARMS))


def history_validity(nodes: DataFrame) -> DataFrame:
    """tree, node, txn and why a history batch is refused (ok if it isn't)."""
    reason = (
        F.when(F.col("tree").isNull(), "no branch")
        .when(F.coalesce(F.length("events"), F.lit(0)) == 0, "no events")
        .when((F.col("node") > 1) & (F.col("txn") == 0), "new branch without tree info")
        .otherwise("ok")
    )
    return nodes.select("tree", "node", "txn", reason.alias("reason"))


#: Begins a cursor of a merged page; a cursor without it is the base's own.
MAGIC = "TPG1"


def cursor(category: Column, fire_us: Column, task_id: Column) -> Column:
    return F.concat(F.lit(MAGIC), F.to_json(F.struct(category.alias("category"), fire_us.alias("fire_us"), task_id.alias("task_id"))))


def parse_cursor(text: Column) -> Column:
    """The key that a cursor holds; null for a foreign one."""
    inner = F.from_json(F.substring(text, F.lit(len(MAGIC) + 1), F.length(text)), "category long, fire_us long, task_id long")
    return F.when(text.startswith(MAGIC), inner)


#: Begins a cursor of a merged history page, which carries the base's own within.
HISTORY_MAGIC = "HPG1"


def history_cursor(node: Column, txn: Column, base: Column) -> Column:
    """node, txn: the last key of a page; base: the base's cursor, null where it is done."""
    return F.concat(F.lit(HISTORY_MAGIC), F.to_json(F.struct(node.alias("node"), txn.alias("txn"), base.alias("base"))))


def parse_history_cursor(text: Column) -> Column:
    """node, txn, base of a cursor; a foreign one is all base, as of a page that the base
    alone has answered; null for none."""
    inner = F.from_json(F.substring(text, F.lit(len(HISTORY_MAGIC) + 1), F.length(text)), "node long, txn long, base string")
    none = F.lit(None).cast("long")
    return F.when(text.startswith(HISTORY_MAGIC), inner).when(text.isNotNull(), F.struct(none.alias("node"), none.alias("txn"), text.alias("base")))
