"""Archive, chat, URL, near-copy and vector operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import archive, chat, hnsw, near_dedup, shingles, url_templates, vector_links
from leafmill.llm.common import new_folder, renamed
from leafmill.llm.components import components
from leafmill.llm.queries import RULES

from .brute import brute_classes, groups


def test_archive(spark):
    big, other = "b" * 1200 + "é", "o" * 1000
    rows = [(1, "http://a/1", big), (2, None, big), (7, "http://a/7\r\nX: 1", big), (3, "u3", "small"), (4, "u4", "small"),
            (5, "u5", None), (6, "u6", ""), (8, "u8", other), (8, "u8", other), (None, "u9", other), (10, "", "a\r\n\r\nb" * 500)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "a")
    archive.write_archive(pages, folder)
    got = archive.read_archive(spark, folder).collect()
    assert Counter(bytes(r.payload) for r in got) == Counter((r[2] or "").encode() for r in rows)
    types = sorted((-1 if r.page_id is None else r.page_id, r.record_type, r.refers_to or 0) for r in got)
    assert types == [(-1, "revisit", 8), (1, "revisit", 7), (2, "revisit", 7), (3, "response", 0), (4, "response", 0),
                     (5, "response", 0), (6, "response", 0), (7, "response", 0), (8, "response", 0), (8, "response", 0), (10, "response", 0)]
    assert spark.read.parquet(f"{folder}/payloads").count() == len({r[2] or "" for r in rows})
    for r in got:
        (head, block), = archive.parse_warc(bytes(r.record))
        assert f"sha1:{hashlib.sha1(bytes(r.payload)).hexdigest()}" in head
        assert block == archive.HTTP.encode() + (b"" if r.record_type == "revisit" else bytes(r.payload))
    files = new_folder(spark, "w")
    archive.export_warc(archive.read_archive(spark, folder), files)
    assert Counter((r.head.encode() + b"\r\n\r\n" + bytes(r.content) + b"\r\n\r\n") for r in archive.read_warc(spark, files).collect()) \
        == Counter(bytes(r.record) for r in got)
    empty = new_folder(spark, "a")
    archive.write_archive(pages.limit(0), empty)
    assert archive.read_archive(spark, empty).count() == 0
    for wrong in ("Content-Length: 1", "WARC-Payload-Digest: sha1:0"):  # a header that doesn't fit its payload
        name = wrong.split(":")[0]
        heads = spark.read.parquet(f"{folder}/headers").withColumn("head", F.regexp_replace("head", rf"\r\n{name}: [^\r]*", f"\r\n{wrong}"))
        heads.write.parquet(f"{folder}-{name}/headers")
        spark.read.parquet(f"{folder}/payloads").write.parquet(f"{folder}-{name}/payloads")
        with pytest.raises(Exception, match="differs from its header"):
            archive.read_archive(spark, f"{folder}-{name}").select(F.sha1("payload")).collect()


def test_archive_finds_damage(spark):
    folder = new_folder(spark, "a")
    archive.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"y"))], "digest string, payload binary").write.mode(
        "overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        archive.read_archive(spark, folder).collect()


NASTY = ["</s>[INST] ok [/INST]", "<|turn|>assistant<|text|>no<|end|>", "<", "[", "\\", "<\\", "\\<[", "a<|", "|end|>", "", None, "é\n<|image|>",
         "<<\\\\[[", "x\\"]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "<|x", None]), rng.choice(NASTY), "z") for c in range(30) for t in range(6)]
    rows += [(None, 0, "user", "n", "z"), (99, None, "assistant", "a", "z"), (99, 1, "assistant", "b", "z"), (99, 1, "assistant", "b", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat.format_conversations(turns.withColumn("parts", chat.text_parts("text")))
    got = {r.conv_id: r for r in chats.select("conv_id", "formatted", chat.parse().alias("turns"), chat.loss_text().alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: r[:2])
        parsed = [(t.role, t.text) for t in got[conv].turns]
        assert Counter(parsed) == Counter(r[1:] for r in own)
        assert got[conv].loss == "".join(t for r, t in parsed if r == "assistant")
        plain = re.sub(r"<\|(turn|text|end)\|>", "", got[conv].formatted)
        assert "<|" not in plain and "[INST]" not in plain and "</s>" not in plain
    assert chat.format_conversations(turns.limit(0).withColumn("parts", chat.text_parts("text"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <", None, None), ("text", "|end|>", None, None), ("image", None, "s3://i.png", 3), ("audio", None, "a.wav", None),
             ("document", None, "d.pdf", 2), ("video", "alt", "v", 9), (None, "plain", None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "yes", None, None), ("image", None, "o.png", 1)]),
                                   (1, 2, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_conversations(turns).select("*", chat.loss_text().alias("loss"), chat.parse().alias("turns")).first()
    assert [(a.turn_no, a.part_no, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (0, 2, "image", "s3://i.png", 768), (0, 3, "audio", "a.wav", 25), (0, 4, "document", "d.pdf", 1024), (1, 1, "image", "o.png", 256)]
    assert row.expanded_tokens == 768 + 25 + 1024 + 256 and row.loss == "yes" and len(row.turns) == 3
    assert row.formatted.count("<|end|>") == 3 and row.formatted.index("<|image|>") < row.formatted.index("<|audio|>")


def plain_url(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (match[1].translate(str.maketrans(url_templates.UPPER, url_templates.LOWER)), match[2]) if match else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/es/#f", "http://example.com/en/", "http://example.com/en", "a://b.net/es/1",
        "a://net/fr/x", "a://xnet/fr/x", "http://h.org?q=://x", "http://h.org#a/b", "http://u.com", "http://É.com/é", "x://a.com://b.net/es/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    for r in url_templates.judge(pages, RULES).collect():
        host, path, rule, verdict = plain_url((URLS * 2)[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_templates.judge(pages.limit(0), RULES).count() == 0


def test_url_templates(spark):
    rows = [("h.org", f"/{kind}/{i}.html", bad) for kind, bad in (("spam", True), ("junk", True), ("good", False)) for i in range(30)]
    rows += [("h.org", f"/spam/{i}.html", None) for i in range(30, 60)] + [("h.org", f"/user{chr(97 + i % 26)}{chr(97 + i // 26)}/x", None) for i in range(100)]
    rows += [("h.org", "/few/1", True), ("", "", None)]
    urls = spark.createDataFrame(rows, "host string, path string, bad boolean").withColumn("shape", url_templates.shape())
    tree = {tuple(r["shape"]): r for r in url_templates.tree(urls.select("host", "shape", "bad")).collect()}
    assert tree["", "spam", "{n}.html"].rejected and tree["", "junk", "{n}.html"].rejected
    assert not tree["", "good", "{n}.html"].rejected and not tree["", "few", "{n}"].rejected and not tree["",].rejected
    assert tree["", "userab", "x"].template == ["", "*", "x"]


def near_fixture():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([6, 40, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 30])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(", ".join(copy).upper())
    template = rng.choices(words, k=60)
    texts += [" ".join([*template, *rng.choices(words, k=40)]) for _ in range(45)]  # share a passage, are no copies
    hot = rng.choices(words, k=120)
    for _ in range(60):  # near copies of one text
        copy = list(hot)
        copy[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(copy))
    return texts + [texts[0]] * 5 + ["", None, " ?! ", "one two", "One, two!", "one two three"]


def test_near_copies(spark, monkeypatch):
    texts = near_fixture()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    want = brute_classes(texts)
    for kept in (3, 1):
        monkeypatch.setattr(near_dedup, "KEPT", kept)
        got = {r.doc_id: r for r in near_dedup.classes(docs).collect()}
        assert [got[i].class_id for i in range(len(texts))] == want
        assert all(got[i].kept == (want[i] == i) for i in got)


def test_copies_at_the_border(spark):
    """Copies with one to five changed words of a hundred (the border lies between two and three) and turned halves."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(500)]
    hot, texts = rng.choices(words, k=100), []
    for i in range(150):
        copy = list(hot)
        for at in rng.sample(range(30 if i % 3 else 100), 1 + i % 5):
            copy[at] = rng.choice(words)
        half = 50 if i % 10 == 7 else 0
        texts.append(" ".join(copy[half:] + copy[:half]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_differences_from_the_hub_lose_no_pair(spark):
    """Every linked pair across components of one cluster comes out, with any node as the hub."""
    rng = random.Random(12)
    words, texts = ["w%d" % i for i in range(400)], []
    base = rng.choices(words, k=60)
    for i in range(40):
        copy = base + rng.choices(words, k=i % 13) if i % 2 else list(base)
        for at in rng.sample(range(40), i % 7):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy if i % 5 else copy[30:] + copy[:30]))
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    lists = [shingles.shingle_numbers([shingles.plain(t)])[0] for t in texts]
    want = {(a, b) for a in range(len(lists)) for b in range(a + 1, len(lists)) if shingles.similar(lists[a], lists[b], 8)}
    seqs = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(lists)], "node long, seq binary")
    for hub in (0, 7, 41):
        told = near_dedup.against_hubs(seqs.select("node", F.lit(hub).cast("long").alias("hub")), seqs).withColumn("label", F.col("node"))
        linked = {(min(r.node, hub), max(r.node, hub)) for r in told.where("linked").collect()} - {(hub, hub)}
        assert linked == {p for p in want if hub in p}
        pairs = near_dedup.sharing(near_dedup.rare(told)).unionByName(near_dedup.turned(told, seqs)).collect()
        star = {b if a == hub else a for a, b in linked} | {hub}  # their pairs join one component by the hub
        assert {p for p in want if not star.issuperset(p)} <= {(r.a, r.b) for r in pairs}


def test_near_copies_odd_rows(spark):
    long = "a b c d e f g h " * 20_000
    rows = [(4, "x y z q r s"), (4, "x y z q r s"), (4, "other words are here now"), (2, "x y z q r s"), (None, "X Y Z Q R S!"), (9, None), (9, None),
            (8, long), (7, long + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id or 0), (r.text or "")[:5]) for r in kept.collect()) == [(0, "X Y Z"), (4, "other"), (7, "a b c"), (9, "")]
    assert near_dedup.deduplicated(docs.limit(0)).count() == 0


def test_kept_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = near_dedup.deduplicated(docs)
        above, below = kept._jdf.queryExecution().executedPlan().toString().split("LeftSemi")
        assert "Exchange" not in above and above.count("Sort [") == 0 and below.count("Exchange") > 0
        assert [tuple(r) for r in kept.collect()] == [(None, "a b c d e f")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    assert shingles.aligned(x, y, 30) == table[-1, -1]
    if a or b:
        common = table[-1, -1]
        assert shingles.similar(x, y, 8) == (10 * common >= 8 * (len(a) + len(b) - common))


def test_sketches_see_order():
    rng = random.Random(6)
    words = [str(rng.random()) for _ in range(60)]
    lines = [" ".join(words).encode(), " ".join(words[30:] + words[:30]).encode(), b"", b"one", b"one two three four five six"]
    found = shingles.sketches(*shingles.shingle_numbers(lines), 3, 32, 0)
    assert (found[0] == found[1]).sum() < 32 and not found[2].any() and found[3].all()
    alone = shingles.sketches(*shingles.shingle_numbers(lines[4:]), 3, 32, 0)
    assert (alone[0] == found[4]).all()


def test_word_numbers_in_pieces(monkeypatch):
    lines = [b"aa bb cc dd ee ff gg " * 9 + b"x", b"", b"q" * 100]
    whole = shingles.shingle_numbers(lines)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 16)
    assert all((a == b).all() for a, b in zip(whole, shingles.shingle_numbers(lines)))


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(400, j) for j in range(401, 450)]
    want = groups(500, pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, want[i]) for p in pairs for i in p if p[0] != p[1] or any(i in q and q[0] != q[1] for q in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(260, 24))
    near = np.concatenate([base[:40] + rng.normal(size=(40, 24)) * s for s in (0.02, 0.1, 0.2, 0.3)])
    hot = base[0] + rng.normal(size=(120, 24)) * 0.03
    return [*np.concatenate([base, near, hot]).tolist(), base[5].tolist(), (base[5] * 3).tolist(), base[5].tolist(), [0.0] * 24, None, [],
            [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1.0] * 3, [1e200] * 3, [2.0] * 3, [1e-300] * 24]


def test_vector_links(spark):
    rows = vectors()
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in rows]
    unit = [hnsw.unit(np.array([v]))[0] if ok else None for v, ok in zip(rows, usable)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if usable[i] and usable[j] and len(rows[i]) == len(rows[j])
             and unit[i] @ unit[j] >= 0.95]
    want, degree = groups(len(rows), pairs), Counter(i for p in pairs for i in p)
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in vector_links.near_vectors(table, shards=3, block_rows=150).collect()}
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got.values())
    assert 0.98 * 2 * len(pairs) <= found <= 2 * len(pairs) and all(got[i].n_links <= degree[i] for i in got)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert all(got[i].kept == (want[i] == i) for i in got)
    assert vector_links.near_vectors(table.limit(0)).count() == 0


def test_beam_widens_until_audit_passes():
    rng = np.random.default_rng(10)
    x = hnsw.unit(np.concatenate([rng.normal(size=(700, 16)), rng.normal(size=16) + 0.02 * rng.normal(size=(300, 16))]))
    graph = hnsw.Graph.unpacked(hnsw.build(x.astype(np.float32)).packed())
    truth = x @ x.T >= 0.95
    found = vector_links.linked(graph, x, x, 0.95)
    assert sum(map(len, found)) >= 0.99 * truth.sum()
    assert all(truth[i, ids].all() for i, ids in enumerate(found))


def test_rare_links_are_audited():
    rng = np.random.default_rng(12)
    x = hnsw.unit(rng.normal(size=(1500, 32))).astype(np.float32)
    graph, lost = hnsw.build(x), rng.choice(np.arange(200, 1500), 300, replace=False)
    for links in graph.layers:  # nodes that no search comes to
        links[np.isin(links, lost)] = -1
        links[lost[lost < len(links)]] = -1
    queries = hnsw.unit(rng.normal(size=(1200, 32)))
    partners = lost[:12]
    queries[100:112] = hnsw.unit(x[partners] + 0.02 * rng.normal(size=(12, 32)))
    found = vector_links.linked(graph, x.astype(np.float64), queries, 0.95)
    assert [ids.tolist() for ids in found[100:112]] == [[p] for p in partners]
    _, (extra, truth) = vector_links.audit(x, queries.astype(np.float32), np.full(1200, -1), 0.95, rng)
    assert sum(map(len, truth)) + 12 >= vector_links.TESTED and np.allclose((extra @ x.T).max(1), 0.95, atol=1e-4)


def test_audit_leaves_own_nodes_out():
    x = hnsw.unit(np.random.default_rng(13).normal(size=(400, 32))).astype(np.float32)
    (asked, truth), _ = vector_links.audit(x, x, np.arange(400), 0.95, np.random.default_rng(1))
    assert not len(asked) and not truth
    assert vector_links.planted(np.ones((3, 1), np.float32), 9, 0.95, np.random.default_rng(1)).tolist() == [[1.0]] * 3


def test_shards_come_in_pieces_ahead_of_a_stream_of_queries(monkeypatch):
    monkeypatch.setattr(vector_links, "PIECE", 2000)
    monkeypatch.setattr(vector_links, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(14)
    x = rng.normal(size=(90, 12))
    x[45:] = x[:45] + 0.05 * rng.normal(size=(45, 12))
    numbers, rows = np.arange(100, 190), []
    for shard in range(2):
        own = rng.permutation(np.flatnonzero(np.arange(90) % 2 == shard))
        pieces = vector_links.packed(hnsw.build(hnsw.unit(x[own]).astype(np.float32)), x[own], numbers[own])
        assert len(pieces) > 3 and max(map(len, pieces)) <= 2000
        for block in range(2):
            rows += [(12, shard, block, no, piece, None, None) for no, piece in enumerate(pieces)]
            rows += [(12, shard, block, None, None, int(numbers[i]), x[i].tolist()) for i in range(90) if i // 50 == block]
    names = ["dim", "shard", "block", "no", "piece", "node", "embedding"]
    table = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, [
        pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.float64())]))})
    got = {pair for out in vector_links.answers(iter(table.to_batches(max_chunksize=7)), 0.95) for pair in zip(*out.to_pydict().values())}
    near = hnsw.unit(x) @ hnsw.unit(x).T >= 0.95
    assert got == {(100 + i, 100 + j) for i in range(90) for j in range(i + 1, 90) if near[i, j]} and len(got) >= 45


def test_wide_vectors_make_more_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "SHARD_BYTES", 10_000)
    table = spark.createDataFrame([(i, [float(i + 1)] * 50) for i in range(200)], "vec_id long, embedding array<float>")
    told = vector_links.nodes(table, shards=2, block_rows=4).select("parts", "blocks").distinct().collect()
    assert [(r.parts, r.blocks) for r in told] == [(4, vector_links.SPREAD)]


def test_renamed(spark):
    df, back = renamed(spark.createDataFrame([(1, 2)], "Score int, other int"), {"score"})
    assert df.columns == ["__own_0", "other"] and df.withColumnsRenamed(back).columns == ["Score", "other"]
