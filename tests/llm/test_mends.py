"""Long regular words, names of columns, and workers that do not have the package."""

import os
import subprocess
import sys

import numpy as np
import public_tokenizers
from helpers import frame
from tokenizers import Tokenizer

from designstats.llm import op1_jaccard, op2_lines, op7_toxicity, tokens
from designstats.llm.arrays import words
from designstats.llm.tokens import Encoder


def morse(n: int) -> list[str]:
    """Two different words of 2 ** n letters whose polynomial hashes modulo 2 ** 64 are equal for n of 10 and more."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return [one, one.translate(str.maketrans("ab", "ba"))]


def test_long_regular_words_are_told_apart(spark):
    for n in (8, 10, 11, 12):
        assert len(set(words(morse(n))[0].tolist())) == 2
    one, two = morse(11)
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        library, own = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), kind)
        for text in (one, two, f"x {two} y {one}"):
            assert own.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    rows = [(1, one), (2, two), (3, f"{one}\n{two}")]
    classes = {r.doc_id: r.class_id for r in op1_jaccard.jaccard_classes(frame(spark, rows[:2])).collect()}
    assert classes == {1: 1, 2: 2}
    kept = {r.doc_id: r.text for r in op2_lines.dedup_lines(frame(spark, [(3, f"{one}\n{two}")])).collect()}
    assert kept[3] == f"{one}\n{two}"


def test_ids_stay_the_librarys_when_pre_tokens_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    texts = [" ".join(f"word{(i * k) % 97} of it" for k in range(20)) for i in range(30)]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        library, own = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), kind)
        for t in texts + texts[:3]:
            assert own.ids([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(own.key) < 120


def test_names_of_columns_are_the_callers_own(spark):
    names = ("_id", "_copy", "_text", "_kept", "_k_id", "_first_doc", "score", "column 0", "scored_text")
    rows = frame(spark, [(1, "one line of text"), (2, "another line of text"), (2, None)], extra=False)
    for k, c in enumerate(names):
        rows = rows.selectExpr("*", f"'{k}' AS `{c}`")
    for out in (op1_jaccard.keep_one(rows), op2_lines.dedup_lines(rows).drop("_n_lines", "_n_kept")):
        assert out.columns == rows.columns
        got = out.collect()
        assert len(got) == 3 and all(r[c] == str(k) for r in got for k, c in enumerate(names))
    model = op7_toxicity.Model(op7_toxicity.CharModel(np.zeros(op7_toxicity.SYMBOLS ** 2, dtype=np.int64)), np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    out = op7_toxicity.score_documents(rows, model)
    assert sorted(out.columns) == sorted(rows.columns) and {r.score for r in out.collect()} == {0.5}


def test_long_chunks_are_decoded_part_by_part():
    counts = op7_toxicity.bigrams(["you are an idiot and a moron too, an idiot you are"] * 50)
    model = op7_toxicity.CharModel(counts)
    chunk = "you_4re_an_1d10t_and_a_m0r0n_too_and_more_words"
    assert len(chunk) > op7_toxicity.PART
    read = op7_toxicity.decode([chunk, "1d10t"], model)
    assert "idiot" in read[0].split() and read[1] == "idiot"
    assert len(op7_toxicity.decode(["x4" * 40_000], model)[0]) > 0


def test_context_trees_without_the_package_on_the_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession, functions as F
sys.path.insert(0, {root!r})
from designstats.llm import op4_context_tree
sys.path.remove({root!r})
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
df = spark.createDataFrame([(k, 'some words of a text ' * k) for k in range(6)], 'doc_id long, text string')
print('rows', op4_context_tree.score_documents(df, F.col('doc_id') == 5).count())
op4_context_tree.score_documents(df, F.col('doc_id') == 5).collect()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows 6" in done.stdout, done.stderr[-2000:]
