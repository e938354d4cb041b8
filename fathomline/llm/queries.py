"""The queries of this subpackage: name -> function of (spark, folder of tables), and the SQL of those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import alignment, chat, decontaminate, exact_dup, language, near_dup, packing, pii, pseudo_likelihood, quality, token_files, toxicity, whitening
from fathomline.llm.shared import read_table


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: what folds rows into held-out ones and others."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file(), end=1)


def op2_fingerprint_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    control = {"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}
    more = spark.createDataFrame([(-1, 0, json.dumps(control))], f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn int, raw string")
    every = chat.format_chats(rows.select("conv_id", "turn", F.struct("turn", "role", "text").alias("raw"))).unionByName(chat.format_chats(more))
    read = every.withColumns({"_turns": chat.read_turns(F.col("formatted")), "_loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))})
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.when(F.col("n_rejected") == 0, F.size("_turns").cast("bigint")).otherwise(F.raise_error(F.lit("a turn has no layout"))).alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op4_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file(), end=2)
    return token_files.read_digests(spark, files)


def op5_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = language.languages(docs, docs.where(remainder(3) != 1))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    counts = pseudo_likelihood.word_counts(docs)
    return pseudo_likelihood.scores(docs, pseudo_likelihood.fit(docs, counts=counts), counts=counts)


def op7_grace_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op8_fast_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return quality.quality(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op10_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.toxicity(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op12_block_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(read_table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


SQL: dict[str, str] = {
    "op2_fingerprint_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e as (select *, 2 * length(r) - length(regexp_replace(r, '[\\|\[<]', '', 'g')) + 2 * length(t) - length(regexp_replace(t, '[\\|\[<]', '', 'g')) + 10 as size from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn)) as turns_sha256,
            cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(t, '' order by turn) filter (where r = 'assistant'), '')) as loss_sha256,
            cast(sum(size) as bigint) as formatted_chars
        from e group by conv_id""",
    "op7_grace_hash_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
        g as (select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
            row_number() over (partition by text_sha256 order by doc_id) as place from t)
        select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g""",
    "op8_fast_sketch_near_dedup": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as shingle from d where len(w) > 0),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
        m as (select a, min(b) as least from r group by a)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) as component_id, d.doc_id <= coalesce(m.least, d.doc_id) as kept
        from d left join n using (doc_id) left join m on m.a = d.doc_id""",
    "op10_fm_index_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        p as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as phrase
            from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
        lengths as (select distinct n from p),
        s as (select doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'i': i, 'phrase': array_to_string(w[i : i + n - 1], ' ')})) as x from d, lengths where len(w) >= n),
        hits as (select doc_id, x.i as i, p.n, item_id from s join p on s.n = p.n and s.x.phrase = p.phrase),
        places as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as list from (select distinct doc_id, item_id from hits) group by doc_id)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join places using (doc_id) left join items using (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
