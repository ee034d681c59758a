"""The pipeline's stages: columns, decisions and hard rows."""

import corpus_pipeline
import pytest
from helpers import hard_rows, prose

BAD = ["idiot", "moron", "scum"]
ITEM = prose(77, 30)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = hard_rows()
    rows += [(1000 + k, prose(k, 40) + (f" you {BAD[k % 3]} and {BAD[(k + 1) % 3]}" if k % 4 == 0 else "")) for k in range(200)]
    rows += [(3000, "before\n" + ITEM + "\nafter"), (3001, prose(500, 80)), (3002, prose(500, 80))]
    near = prose(501, 200).split()
    rows += [(3003, " ".join(near)), (3004, " ".join([*near[:50], "changed", *near[51:]]))]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, id string")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1000 + k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_one_after_the_other(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    toxic = {1000 + k for k in range(0, 200, 4)}
    assert len(toxic & set(kept["toxicity"])) <= 2 and not set(range(1000, 1200)) - toxic - set(kept["toxicity"])
    assert sorted(map(str, kept["line_dedup"])) == sorted(map(str, kept["toxicity"]))
    after = {r.doc_id: r for r in docs.collect()}
    assert 3000 in kept["near_copies"] and 3000 not in kept["decontaminate"]
    assert 3001 in after and 3002 not in after  # an exact copy loses all its lines, and the empty texts are one class
    assert 3003 in after and kept["near_copies"].count(9) <= 2
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_near_copies_of_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, folder).collect()}
    assert 3001 in ids and 3002 not in ids and 3003 in ids and 3004 not in ids and 7 in ids and 8 not in ids


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    from designstats.llm import queries

    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES and set(queries.ORACLES) <= set(queries.QUERIES)
