"""The corpus pipeline: each stage on what the one before wrote."""

import re

import corpus_pipeline
from ledgerfold.llm import lines, mixing, simhash, toxicity
from ledgerfold.llm.common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, states = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, states[-1], sf)
        if name != "packing":
            assert out.columns == columns
        folder = new_folder(spark, "stage-test")
        out.write.parquet(folder)
        states.append(spark.read.parquet(folder))
    toxic, deduped, unique, mixed, packed = states[1:]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rejected = ids(toxicity.scores(docs, labels).filter("score >= 0.3"))
    assert ids(toxic) == ids(docs) - rejected

    kept = lines.deduplicate(toxic).collect()
    want = {r["doc_id"]: r["kept"] for r in kept if not r["dropped"] or r["kept"].strip()}
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())

    classes = simhash.classes(deduped).collect()
    assert ids(unique) == {r["component_id"] for r in classes} and unique.count() == len(ids(unique))

    sizes = {r["doc_id"]: r["taken"] for r in mixing.place_words(unique).withColumn("taken", mixing.taken()).collect()}
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    assert words == {d: n for d, n in sizes.items() if n}

    assert packed.agg({"size": "sum"}).first()[0] == sum(words.values())


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in all columns, rows that share or lack an id, empty, blank and long texts."""
    texts = [None, "", " \t\n ", "one", "two words", "a b c d e f g h", "a b c d e f g h", "Ünï 文字 ok", "x" * 30_000, "w " * 9000]
    rows = [(i // 2 if i % 3 else None, t, None if i % 2 else "en", None if i % 4 else f"s{i % 3}", None if i % 5 else 7) for i, t in enumerate(texts * 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    for name, some, known in (("odd", rows, labels), ("unlabelled", rows, labels.limit(0)), ("empty", [], labels)):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{sf}/documents.parquet")
        known.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        sizes = out.agg({"size": "sum"}).first()[0]
        if name != "odd":  # whose labels say nothing, so that documents may all be rejected
            assert (sizes or 0) > 0 if name == "unlabelled" else sizes is None


def test_no_class_is_lost(spark):
    """Documents that are no copies stay, also those that share a doc_id or have none."""
    rows = [(None, "alpha beta gamma delta"), (None, "one two three four"), (5, "red green blue grey"), (5, "north south east west"), (9, "do re mi fa"), (9, "do re mi fa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(d), t) for d, t in rows[:5])


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "size", "bin", "capacity", "place"} <= set(out.columns) and out.count() > 0
