import re

import corpus_pipeline
from listingloom.llm import packing, toxicity
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_minhash import brute as copies
from tests.llm.test_packing import check, expected

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages_match_brute_force(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    item = spark.read.parquet(f"{sf001}/benchmark.parquet").first().text
    planted = [(10_001, None, None, None, None), (10_002, "12 34 %%", None, "x", 8), (10_003, f"Start {item} end of it", "en", "x", 1), (10_004, f"start {item} end of it", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}

    kept = steps["language"](spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS and ids(kept) == {i for i, t in rows.items() if re.search(r"[^\W\d_]", t or "")}

    model = toxicity.train(*toxicity.labelled_sample(kept, labels))
    calm = steps["toxicity"](spark, kept, str(tmp_path))
    assert ids(calm) == {i for i in ids(kept) if toxicity.probability(rows[i], model) < toxicity.THRESHOLD}

    single = steps["near_dedup"](spark, calm, str(tmp_path))
    assert ids(single) == {i for i, r in copies([(i, rows[i]) for i in ids(calm)]).items() if r[2]} and 10_004 not in ids(single)

    clean = steps["decontamination"](spark, single, str(tmp_path))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    found = {k[0] for k in leaks([(i, rows[i]) for i in ids(single)], bench)}
    assert ids(clean) == ids(single) - found and 10_003 in found

    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == expected([(i, rows[i]) for i in ids(clean)])
    check(packed)


def test_stages_take_empty_tables_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0 and docs.columns == COLUMNS
    assert packing.pack(docs, packing.default_path()).count() == 0
    some = spark.createDataFrame([(1, "some words of a text", "en", "s", 20, "x"), (None, "other words here now", None, None, None, None)], schema + ", rejected_id string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        some = stage(spark, some, str(tmp_path))
    assert {r.doc_id for r in some.collect()} == {1, None}


def test_decisions_are_made_row_by_row(spark, sf001, tmp_path):
    """Texts that share a doc_id, and rows without one, are judged each on its own."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    item = spark.read.parquet(f"{sf001}/benchmark.parquet").first().text
    plain = ["a quiet morning by the river with tea", "seven boats left the harbour before noon today", "letters about the garden and its old wall", "they counted every lamp along the station road"]
    copy = " ".join(f"word{i}" for i in range(40))
    rows = [(7, plain[0]), (7, "12 34"), (None, "56 %%"), (None, plain[1]), (7, f"Now {item} it ends"), (None, f"then {item} it ends there"), (8, copy), (None, copy), (9, copy + " end"), (3, copy), (7, plain[2]), (7, plain[2]), (None, plain[3]), (None, plain[3])]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    after = lambda name, df: sorted(((r.doc_id, r.text) for r in steps[name](spark, df, str(tmp_path)).collect()), key=str)
    assert after("language", docs) == sorted([r for r in rows if re.search(r"[^\W\d_]", r[1])], key=str)
    assert after("near_dedup", docs) == sorted([r for r in dict.fromkeys(rows) if copy not in r[1] and not r[1].startswith("then")] + [(3, copy)], key=str)
    assert after("decontamination", docs) == sorted([r for r in rows if item not in r[1]], key=str)
    calm = toxicity.train(*toxicity.labelled_sample(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert after("toxicity", docs) == sorted([r for r in rows if toxicity.probability(r[1], calm) < toxicity.THRESHOLD], key=str)
