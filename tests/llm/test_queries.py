"""Registered queries against their SQL, and the pipeline against brute force."""

import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registry
from leafmill.llm import queries
from leafmill.llm.queries import CAPACITY, word_tokenizer

from .brute import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    want = con.sql(queries.ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_all_are_registered():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and names["pipeline"]
    assert not set(queries.ORACLES) - set(names)


def corpus():
    rng = random.Random(12)
    english = "the of and to in was that this with from have are".split()
    words = lambda n: " ".join(rng.choice(english) + rng.choice("abcdefgh") * rng.randint(0, 3) + str(rng.randint(0, 99)) for _ in range(n))
    items = [words(14) for _ in range(4)] + [words(6)]
    docs = [words(rng.choice([3, 30, 120, 400])) for _ in range(60)]
    docs += [docs[5], docs[7].upper(), docs[8] + " tail", words(20) + " " + items[1] + ". " + words(9), items[4] + " " + words(30),
             words(25) + " " + " ".join(items[2].split()[:9]), None, "", "123 456", words(3000)]
    return docs, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    texts, items = corpus()
    rows = [(i, t, "en", "s", len(t or ""), 1.5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), set(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        if name == "language":
            kept = {i for i in kept if re.search("[^\\W\\d_]", texts[i] or "")}
        elif name == "near_duplicates":
            of = brute_classes(texts)
            kept = {i for i in kept if of[i] == i}
        else:
            split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            held = {tuple(w[k:k + min(10, len(w))]) for w in map(split, items) for k in range(max(1, len(w) - 9))}
            kept = {i for i in kept if not any(tuple(split(texts[i])[k:k + len(h)]) == h for h in held for k in range(len(split(texts[i]))))}
        got = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(got) == kept and len(got) == len(kept) + (name == "language")
    library = Tokenizer.from_file(word_tokenizer()[0])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {i: [*library.encode(texts[i], add_special_tokens=False).ids, 0] for i in kept}
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == sorted(
        (i, s, len(x[s:s + CAPACITY]), zlib.crc32(np.array(x[s:s + CAPACITY], "<u4").tobytes())) for i, x in ids.items() for s in range(0, len(x), CAPACITY))


def test_pipeline_takes_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_query_covers_all_ids(spark):
    library = Tokenizer.from_file(word_tokenizer()[0])
    docs = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op2_best_fit_packing"](spark, SF)
    lengths = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(ids) + 1 for i, ids in docs.items()}
