"""Token files, packing, counts, decontamination and language ID against the libraries and brute force."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import decontaminate, language_id, packing, token_files, trie_counts
from leafmill.llm.chunk_encoder import ChunkEncoder
from leafmill.llm.common import new_folder
from leafmill.llm.queries import byte_tokenizer, word_tokenizer

ODD = ["", " ", "\n", "  ", " a", "a ", "a\tb  c\n\nd", "a \nb", "Σας ΟΔΟΣ İx", "\x00a b", "a\x01", "é ́x", "12 345  5\r\n",
       "<|endoftext|> hi<|endoftext|>there", "don't we'll", "x" * 300, "漢字 かな", "a\u00a0b \u2003c", "THE The the, the. (the)"]


def schema(extra=""):
    return "doc_id long, text string" + extra


@pytest.fixture(scope="module")
def encoders():
    word, byte = word_tokenizer(), byte_tokenizer()
    return ChunkEncoder(*word, False), ChunkEncoder(*byte, True)


def check_encoding(own, texts):
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_equals_library(encoders):
    for own in encoders:
        check_encoding(own, ODD)
        check_encoding(own, ODD[::-1])


def test_short_pieces_reach_the_model_once_and_the_cache_has_the_size_asked_for():
    own = ChunkEncoder(*byte_tokenizer(), True, 100)
    assert own.chunks.entries == 100
    asked, ids = [], own._ids
    own._ids = lambda name: asked.append(name) or ids(name)
    texts = [f"Zug{i}a$$$\nRad{i}b$$$\nTor{i}c$$$" for i in range(60)]
    found, bounds = own.encode(pa.array(texts))
    assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [
        own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count(own.table[10]) <= 1 and asked.count("$$$") <= 1


def test_encoder_cache_is_bounded(encoders, monkeypatch):
    monkeypatch.setattr("leafmill.llm.chunk_encoder.CACHE_ENTRIES", 6)
    for own in encoders:
        for _ in range(2):
            check_encoding(own, [*ODD, "one two three four five six seven eight one two", "six  seven one"])
        small = ChunkEncoder(*(word_tokenizer() if not own.blanks_count else byte_tokenizer()), own.blanks_count)
        check_encoding(small, [f"w{i} same word again" for i in range(50)])
        assert len(small.chunks.young) + len(small.chunks.old) <= 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é,.'\n\t \x00\x01<|>ndoftex12ß漢\u00a0"), max_size=40), min_size=1, max_size=6))
def test_encoder_equals_library_on_any_text(encoders, texts):
    for own in encoders:
        check_encoding(own, texts)


def test_token_files(spark):
    rows = [(5, "b text"), (None, "no id"), (2, None), (2, "two"), (9, ""), (7, "long " * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], schema(", tokens int, part int"))
    tokenizer, pattern = byte_tokenizer()
    library = Tokenizer.from_file(tokenizer)
    for encoding in token_files.ENCODINGS:
        folder = new_folder(spark, "t")
        token_files.write_tokens(docs, folder, tokenizer, pattern, 2, encoding)
        got = token_files.read_tokens(spark, folder).collect()
        got.sort(key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 9]
        at = 0
        texts = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
        assert texts == Counter((r.doc_id, tuple(r.tokens)) for r in got)
        crcs = {(r.doc_id, r.start): r for r in token_files.ids_crc32(token_files.read_tokens(spark, folder)).collect()}
        for r in got:
            assert (r.start, r.n_tokens) == (at, len(r.tokens))
            assert crcs[r.doc_id, r.start].ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
            at += r.n_tokens
    folder = new_folder(spark, "t")
    token_files.write_tokens(docs.limit(0), folder, tokenizer, pattern, 2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_token_reads_are_selective(spark):
    folder = new_folder(spark, "t")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    token_files.write_tokens(docs, folder, *byte_tokenizer(), 2)
    plan = token_files.read_tokens(spark, folder, with_tokens=False).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "GreaterThan" in plan or "EqualTo(doc_id,7)" in plan
    assert "tokens:array" not in plan.split("ReadSchema")[1]


def test_packing(spark):
    rng = random.Random(1)
    texts = ["word " * rng.choice([1, 3, 40, 90, 119, 200, 301]) for _ in range(300)] + [None, "", "x " * 1000]
    docs = spark.createDataFrame([(i % 290, t, 0) for i, t in enumerate(texts)], schema(", uid int"))
    rows = packing.pieces(docs, *word_tokenizer(), 0, 128)
    got = packing.pack(rows, 128, pieces_per_part=60).collect()
    assert sum(r.length for r in got) == sum(len((t or "").split()) + 1 for t in texts)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 128
    lengths = np.array([r.length for r in got])
    at_once = len(packing.best_fit(lengths, 128)[2])
    assert packing.lower_bound(np.bincount(lengths, minlength=129)) <= len(seqs) <= at_once + 1
    cut = sorted((r.piece, r.start, r.length) for r in got if r.start or r.length == 128)
    assert (7, 896, 105) in cut  # 1,001 ids
    assert packing.pack(packing.pieces(docs.limit(0), *word_tokenizer(), 0, 128), 128).count() == 0


def test_parts_with_a_gap_exchange_pieces(spark, monkeypatch):
    """Even lengths and an odd capacity: no sequence can be exactly full, all parts have a gap."""
    rounds, once = [], packing.pack_parts
    monkeypatch.setattr(packing, "pack_parts", lambda rows, capacity: rounds.append(rows.select("part").distinct().count()) or once(rows, capacity))
    lengths = F.lit(20) + 2 * F.pmod(F.xxhash64("id"), F.lit(50))
    columns = {"doc_id": F.col("id"), "uid": F.col("id"), "length": lengths}
    rows = spark.range(8000).select(*[columns.get(c.split()[0], F.lit(0)).cast(c.split()[1]).alias(c.split()[0]) for c in packing.PIECES.split(", ")])
    got = packing.pack(rows, 127, pieces_per_part=2000).select("sequence_id", "offset", "length").toPandas()
    ends = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 8000 and ends.max() <= 127 and rounds[0] == 4 and len(rounds) >= 2
    apart = once(rows.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(0)), F.lit(4))), 127).select("part", "bin").distinct().count()
    sizes = np.array(got["length"])
    assert packing.lower_bound(np.bincount(sizes, minlength=128)) <= len(ends) <= apart
    assert len(ends) <= len(packing.best_fit(sizes, 127)[2]) + 2 * rounds[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bound_is_below_optimum(lengths):
    counts = np.bincount(lengths, minlength=13)

    def fits(left, bins):  # exact search
        if not left:
            return True
        tried = set()
        for i, free in enumerate(bins):
            if free >= left[0] and free not in tried:
                tried.add(free)
                if fits(left[1:], [*bins[:i], free - left[0], *bins[i + 1:]]):
                    return True
        return False

    best = next(n for n in range(1, 10) if fits(sorted(lengths, reverse=True), [12] * n))
    assert packing.lower_bound(counts) <= best
    bins, offsets, fill = packing.best_fit(np.array(lengths), 12)
    assert best <= len(fill) and fill.max() <= 12


def unigram(text, vocabulary):
    """Best segmentation of each word by plain dynamic programming over all pieces."""
    tokens, total = 0, 0.0
    for word in text.split():
        word = trie_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + vocabulary.scores[word[s:end]], -(best[s][1] + 1))
                       for s in range(max(0, end - 64), end) if word[s:end] in vocabulary.scores]
            char = word[end - 1]
            if char not in vocabulary.scores:
                n = len(char.encode())
                options.append((best[end - 1][0] + n * vocabulary.byte_score, -(best[end - 1][1] + n)))
            score, n = max(options)
            best.append((score, -n))
        tokens, total = tokens + best[-1][1], total + best[-1][0]
    return tokens, total


def test_trie_counts(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = trie_counts.Vocabulary(path)
    texts = [None, "", " \n ", "the theme of these thesis", "x" * 400, "漢字 ☃☃ café", "the the", "a " * 3000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, "the the"])], schema(", n_tokens int"))
    got = {r.doc_id: r for r in trie_counts.count_tokens(docs, path).collect()}
    for i, text in enumerate(texts):
        tokens, score = unigram(text or "", vocabulary)
        assert (got[i].n_pretokens, got[i].n_tokens) == (len((text or "").split()), tokens)
        assert math.isclose(got[i].log_prob, score, rel_tol=1e-9, abs_tol=1e-9)
    assert trie_counts.count_tokens(docs.limit(0), path).count() == 0
    small = trie_counts.Trie(vocabulary)
    words = [f"{a}{b}{c}" for a in "the a of".split() for b in "abc" for c in "xyz"]
    whole = small.terminals(words)
    monkeypatch.setattr(trie_counts, "MAX_NODES", 5)
    assert all((a == b).all() for a, b in zip(whole, trie_counts.Trie(vocabulary).terminals(words)))


def test_decontamination(spark):
    item = "One two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, "?!"), (5, "short ITEM"), (1, item)],
                                      "item_id long, text string")
    texts = ["x one two, three FOUR five-six seven eight nine ten. eleven y", "a short item", "shortitem short items", None, "",
             "one two three four five six seven eight nine", "short item " * 2000, "Éshort item"]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], schema(", items string"))
    rows = {r.doc_id: r for r in decontaminate.scan(docs, benchmark).withColumn("n_hit", decontaminate.n_hit()).collect()}
    assert [(rows[i].n_words, rows[i].n_hit, rows[i]["items"]) for i in range(8)] == [
        (13, 11, [1]), (3, 2, [2, 5]), (3, 0, []), (0, 0, []), (0, 0, []), (9, 0, []), (4000, 4000, [2, 5]), (2, 0, [])]
    split = {r.doc_id: r for r in decontaminate.scan(docs, benchmark, max_bytes=20).collect()}
    assert all(split[i].hit_words == rows[i].hit_words and split[i]["items"] == rows[i]["items"] for i in rows)
    places = {r.doc_id: texts[r.doc_id][r.start:r.end] for r in decontaminate.spans(decontaminate.scan(docs, benchmark)).collect()}
    assert places[0] == "one two, three FOUR five-six seven eight nine ten. eleven" and places[1] == "short item"
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns and {(r.doc_id, r["items"]) for r in kept.collect()} == {(i, "own") for i in (2, 3, 4, 5, 7)}
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(texts)
    assert decontaminate.clean(docs.limit(0), benchmark).count() == 0


def test_language(spark):
    rng = random.Random(2)
    parts = {"aa": "ka lo mi ta re su no".split(), "bb": "schu ger ein lich zung ver auf".split(), "cc": "eau oux é ai ent que".split()}

    def text(lang, n):
        return " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))

    rows = [(i, text(lang, 60), lang, 0.0) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    odd = [(1000, None, "aa", 0.0), (1001, "", None, 0.0), (1002, "123 !?", "bb", 0.0), (None, text("cc", 50), None, 0.0),
           (1003, text("bb", 60_000), None, 0.0), rows[0]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = language_id.fit(docs, per_language=40, landmarks=24)
    got = language_id.predict(docs.withColumn("held", language_id.held_out()), model).collect()
    held = [r for r in got if r.held and r.lang and r.text and r.lang_pred != "und"]
    assert len(held) > 60 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1002].score == 0
    assert by[None].lang_pred == "cc" and by[None].held and by[1003].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + len(odd)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held for r in got if r.doc_id is not None)
    sample = language_id.training_rows(docs, 40).groupBy("lang").count().collect()
    assert all(r["count"] <= 40 for r in sample)
    kept = language_id.known(docs, 0.1)
    assert kept.columns == docs.columns and kept.where("score <> 0").count() == 0 and kept.count() == len(got) - 3
    assert language_id.fit(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.known(docs.limit(0), 0.1).count() == 0


WORDS = {"en": "the weather was fine and they walked along river with friends while children played near old house under tall trees this morning",
         "de": "das wetter war schön und sie gingen mit freunden am fluss entlang während kinder unter hohen bäumen beim alten haus spielten",
         **{f"x{k}": " ".join(a + b + c for a in "bdfgklmn"[k % 8] + "pt" for b in "aeiou" for c in "rstvz"[k % 5] + "h") for k in range(10)}}
STRANGE = ["ήταν μια όμορφη μέρα και περπατούσαν δίπλα στο ποτάμι", "тёплым утром дети играли у старого дома", "tänään oli kaunis ilma ja kävelimme pitkin jokea ystäviemme kanssa",
           "qxzj vkwq jjxq zzkv wqxj kxvq qqzx", "Добрый день"]


@pytest.mark.parametrize("languages", [1, 2, 12])
def test_unlearned_languages_are_rejected(spark, languages):
    rng = random.Random(4)
    rows = [(lang, " ".join(rng.choices(WORDS[lang].split(), k=rng.choice([2, 3, 8, 60])))) for lang in list(WORDS)[:languages] for _ in range(120)]
    rows += [(None, t) for t in STRANGE] + [(None, "The weather was fine!"), (None, "old house, 12 trees")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    kept = {r.text for r in language_id.known(docs, corpus_pipeline.LEAST_SHARE).collect()}
    assert kept == {t for _, t in rows} - set(STRANGE)


def test_letter_runs_ignore_segments(monkeypatch):
    texts = ["abc déf,  12 " * 50, "", "x", " 1 " * 99 + "zz", "a b" * 70]
    whole = [language_id.letter_runs(t).tolist() for t in texts]
    assert list(map(len, whole)) == [399, 0, 1, 2, len(whole[4])]
    for size in (3, 64):
        monkeypatch.setattr(language_id, "BLOCK_CHARS", size)
        assert whole == [language_id.letter_runs(t).tolist() for t in texts]


def test_presence_ignores_segments(monkeypatch):
    texts = ["abc déf " * 50, "", "x", "zz " * 70]
    whole = language_id.presence(texts)
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 64)
    assert np.array_equal(whole, language_id.presence(texts))
