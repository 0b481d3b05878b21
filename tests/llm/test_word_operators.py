"""Periodic runs, token alignment and repeated passages against brute force."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import queries, run_detection, substring_dedup, token_alignment
from leafmill.llm.perfect_hash import PerfectHash
from leafmill.llm.queries import alignment_files, byte_tokenizer

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", " \t ", "a", "a  b", " lead", "tail ", "\x00a b", "a　b  c", "x\r\ny;\r\n z", "<s>a</s> <|endoftext|>",
       "▁mark here", "漢字 かな ü ß é́", "a " * 40, "a b c " * 9 + "d", "é" * 5000, "x" * 9000, "﻿a ​ b\u0085c \x1cd"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# periodic runs

def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def found_runs(words):
    codes = np.array(words, np.int64)
    return sorted(((s + a, n, q) for s, e in run_detection.surviving(codes, np.zeros(len(codes), np.int64))
                   for a, n, q in run_detection.scan(codes[s:e])), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert found_runs(words) == brute_runs(words)


def test_scan_in_small_groups(monkeypatch):
    monkeypatch.setattr(run_detection, "PLACES", 16)
    rng = random.Random(4)
    for _ in range(200):
        words = [w for _ in range(6) for w in [rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, 5, 12])]
        assert found_runs(words) == brute_runs(words)


def test_long_periodic_text():
    assert found_runs([0] * 300_000) == [(0, 300_000, 1)]
    assert found_runs([*range(700)] * 300 + [0]) == [(0, 210_001, 700)]


def test_run_operator_on_odd_texts(spark, docs):
    rows = {r.doc_id: r for r in run_detection.find_runs(docs(*ODD).withColumn("runs", F.lit(1))).collect()}
    for i, text in enumerate(ODD):
        words = split(text)
        runs = brute_runs(words)
        assert (rows[i].n_words, [tuple(r) for r in rows[i].runs]) == (len(words), runs)
        assert rows[i].collapsed == brute_collapsed(words, runs)
    assert run_detection.find_runs(docs("a").limit(0)).count() == 0
    twice = run_detection.find_runs(spark.createDataFrame([(None, "a " * 9), (None, "a " * 9)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.collapsed) for r in twice] == [(None, "a")] * 2


def test_run_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op11_run_detection"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for i, text in texts.items():
        words, h = split(text), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(words)
        planted += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        want = (i, len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
                sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(brute_collapsed(words, runs)))
        assert tuple(got[i]) == want
    assert planted > 5


# repeated passages

def brute_kept(texts, window):
    """texts: (doc_id, text) -> kept words per row."""
    words = [(i, split(t)) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1) if i is not None else ():
            seq = tuple(w[k:k + window])
            first[seq] = min(first.get(seq, (i, k)), (i, k))
    out = []
    for i, w in words:
        gone = {k + d for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k:k + window])] < (i, k) for d in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def removal(spark, rows, window):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("starts", F.lit(1)).repartition(3)
    got = substring_dedup.without_repeats(frame, window)
    return sorted([(r.doc_id, r.n_words, r.n, r.kept) for r in got.withColumn("n", substring_dedup.n_removed()).collect()], key=repr)


@pytest.mark.parametrize("slice_bytes", [1, 64, 1 << 20])
def test_removal_equals_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring_dedup, "sliced", lambda batches: substring_dedup_sliced(batches, most=slice_bytes))
    rng = random.Random(7)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 12))) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))
                          for _ in range(rng.randint(0, 6)))) for i in (*range(-5, 30), 10**12)]
    rows += [(40, "a a a a a a a a a a a a"), (41, None), (42, ""), (43, " \t\n"), (None, rows[3][1]), (44, rows[3][1]), rows[4]]
    rng.shuffle(rows)
    assert removal(spark, rows, 4) == brute_kept(rows, 4)


substring_dedup_sliced = substring_dedup.sliced


def test_removal_on_odd_and_long_texts(spark):
    long = " ".join(f"w{k % 4001}" for k in range(300_000))
    rows = [*enumerate(ODD), (50, long), (51, long[:2_000_000]), (52, "x " + long[:400])]
    assert removal(spark, rows, 20) == brute_kept(rows, 20)
    assert removal(spark, [], 20) == []


def test_word_hashes_in_pieces(monkeypatch):
    texts = [b"one two  three", b"", None, b" a\tb\n" * 40, b"x" * 300 + b" y"]
    whole = substring_dedup.word_hashes(texts)
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", 7)
    pieces = substring_dedup.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True)) and whole[1].tolist() == [0, 3, 3, 3, 83, 85]


# token alignment

def libraries():
    a = Tokenizer.from_file(byte_tokenizer()[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment_files()[2])


def brute_align(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per text."""
    a, b = libraries()
    table = {ord(c): byte for byte, c in _byte_level().items()}
    cut = []
    for text in texts:
        whole = b" " + (text or "").encode()
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [bytes(table[ord(c)] for c in a.id_to_token(i)) for i in a_ids]
        names = [b.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b_ids, names, strict=True)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            cut.append(([], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        links = [(a_ids[i], b_ids[j]) for i, e in enumerate(a_ends) for j in [b_ends.index(e) if e in b_ends else -1] if j >= 0]
        groups, last = [], 0
        for e in sorted(set(a_ends) & set(b_ends)):
            sides = [",".join(str(x) for x, end in zip(ids, ends, strict=True) if last < end <= e) for ids, ends in ((a_ids, a_ends), (b_ids, b_ends))]
            groups.append("|".join(sides))
            last = e
        cut.append((a_ids, b_ids, groups, links))
    counts = Counter(link for c in cut for link in c[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(len(x), len(y), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(g))
            for x, y, g, links in cut]


def _byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


def aligned(spark, frame):
    return {r.doc_id: tuple(r)[1:] for r in token_alignment.align(frame, *alignment_files()).collect()}


def test_alignment_equals_brute_force(spark, docs, monkeypatch):
    rng = random.Random(3)
    texts = ODD[:-3] + ["é" * 300, "x" * 700, ODD[-1]] + ["".join(rng.choice("ab éX.\n\t▁,'’0漢 ") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += ["The words of it. The words, of  it!\n"] * 3
    want = brute_align(texts)
    frame = docs(*texts).withColumn("groups", F.lit(1)).repartition(5)
    assert aligned(spark, frame) == dict(enumerate(want))
    monkeypatch.setattr(token_alignment, "CALL", 8)
    monkeypatch.setattr(token_alignment, "FAN", 2)
    monkeypatch.setattr(token_alignment, "BLOCK", 16)
    assert aligned(spark, frame) == dict(enumerate(want))


def test_alignment_of_nothing(spark, docs):
    assert aligned(spark, docs("a").limit(0)) == {}
    assert aligned(spark, docs(None, "", "▁")) == dict.fromkeys(range(3), (0,) * 6 + ("",))
    nobody = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.count_sum) for r in token_alignment.align(nobody, *alignment_files()).collect()] == [(None, 4)] * 2


def test_alignment_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (*w[:-1], sha(w[-1]) if w[0] else "") for r, w in zip(rows, brute_align([r.text for r in rows]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()} == want


def test_ranks_equal_the_tokenizer_file():
    """Every assigned code point, alone and beside letters, blanks and digits."""
    a, _ = libraries()
    ranks, pattern, _ = alignment_files()
    own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_alignment.byte_ranks(ranks), special_tokens={})
    points = [c for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    for k in range(0, len(points), 2_000):
        texts = [f"a{chr(c)}1 {chr(c)} b{chr(c)}" for c in points[k:k + 2_000]]
        text = "\nq ".join(texts)
        assert own.encode_ordinary(text) == a.encode(text, add_special_tokens=False).ids, hex(points[k])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    hashed = PerfectHash(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(50, dtype=np.uint64) * np.uint64(0x1234567), keys)
    assert (hashed.slots(others) == -1).all()
