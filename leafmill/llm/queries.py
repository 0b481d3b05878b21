"""Registered queries of the operators, with SQL where it can state the result."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import functions as F

from leafmill.llm import (
    archive, chat, decontaminate, language_id, near_dedup, packing, run_detection, substring_dedup, token_alignment,
    token_files, trie_counts, url_templates, vector_links,
)
from leafmill.llm.common import new_folder

QUERIES, ORACLES = {}, {}
CAPACITY = 2048


def register(name, oracle=None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> tuple[str, str]:
    """Path and pre-token pattern of the word-level tokenizer, the pattern as its own file states it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return path, json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def byte_tokenizer() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@register("op1_order_minhash")
def _(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@register("op2_best_fit_packing")
def _(spark, sf_dir):
    rows = packing.pieces(table(spark, sf_dir, "documents"), *word_tokenizer(), 0, CAPACITY)
    return packing.pack(rows, CAPACITY)


@register("op3_content_archive", """with p as (select page_id, encode(coalesce(html, '')) as body from pages),
    d as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
    o as (select payload_digest, max(page_id) as owner from d group by 1)
    select page_id, payload_bytes, payload_digest,
        case when payload_bytes >= 1000 and page_id <> owner then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 1000 and page_id <> owner then owner end as refers_to
    from d join o using (payload_digest)""")
def _(spark, sf_dir):
    folder = new_folder(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages"), folder)
    return archive.read_archive(spark, folder).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


@register("op4_trie_token_counts")
def _(spark, sf_dir):
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op5_token_files")
def _(spark, sf_dir):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, *byte_tokenizer(), 2)
    return token_files.ids_crc32(token_files.read_tokens(spark, folder))


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op6_decontamination", f"""with d as (select doc_id, coalesce({WORDS}, []::varchar[]) as w from documents),
    b as (select item_id, {WORDS} as w from benchmark where text is not null),
    bw as (select distinct item_id, least(10, len(w)) as n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2),
        lambda i: list_aggregate(w[i:i + 9], 'string_agg', ' '))) as g from b where len(w) > 0),
    sizes as (select distinct n from bw),
    dw as (select doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as g from
        (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
    hits as (select doc_id, i, n, item_id from dw join bw using (n, g)),
    marked as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by 1),
    found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
        from hits group by 1)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join marked using (doc_id) left join found using (doc_id)""")
def _(spark, sf_dir):
    scanned = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return scanned.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
                          F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
                          (F.size("hit_words") > 0).alias("contaminated"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register("op7_url_templates")
def _(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"), RULES)


@register("op8_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@register("op9_chat_format", r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    e as (select *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') as safe,
        replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\') as safe_role from c),
    g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
        sum(8 + length(safe_role) + 8 + length(safe) + 7)::bigint as formatted_chars from e group by conv_id)
    select conv_id::bigint as conv_id, n_turns::bigint as n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars,
        sha256(loss) as loss_sha256, formatted_chars from g""")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(
        "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " as t(conv_id, turn, role, text)"))
    chats = chat.format_conversations(turns.withColumn("parts", chat.text_parts("text")))
    read = chats.select("conv_id", "formatted", chat.parse().alias("turns"), chat.loss_text().alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@register("op10_vector_links")
def _(spark, sf_dir):
    return vector_links.near_vectors(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs):
    """``docs`` in which the words of every tenth document, by the checksum of its id, turn periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    planted = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.element_at("words", (1 + F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


@register("op11_run_detection")
def _(spark, sf_dir):
    found = run_detection.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", run_detection.strongest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start"), F.col("best.length"), F.col("best.period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def alignment_files() -> tuple[str, str, str]:
    """A's ranks (the vocabulary of byte_bpe_50k.json) and pattern, and B's pieces."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@register("op12_token_alignment")
def _(spark, sf_dir):
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), *alignment_files())
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


@register("op13_substring_dedup", r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    g as (select doc_id, i, w[i:i + 19] as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
    later as (select doc_id, i from (select doc_id, i, row_number() over (partition by g order by doc_id, i) as nth from g) where nth > 1),
    gone as (select distinct doc_id, unnest(range(i, i + 20)) as k from later),
    words as (select doc_id, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d),
    kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by k) as text from words anti join gone using (doc_id, k) group by 1)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
    from d left join kept using (doc_id)""")
def _(spark, sf_dir):
    cleaned = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", substring_dedup.n_removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
