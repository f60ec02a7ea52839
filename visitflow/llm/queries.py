"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.llm.common import table
from visitflow.llm.conversation_repair import damaged, repair_reports
from visitflow.llm.edit_fingerprint import edited_fingerprints, near_classes
from visitflow.llm.language_id import fit_languages, held_out, identify_languages
from visitflow.llm.line_dedup import keep_bitmaps, kept_lines, kept_text
from visitflow.llm.merkle import NO_DATE, archive_layout, fixity_audit, warc_record
from visitflow.llm.packing import pack_documents
from visitflow.llm.piece_codec import encode_and_decode
from visitflow.llm.quality import language_references, quality_verdicts
from visitflow.llm.ranked_search import ranked_search
from visitflow.llm.reply_trees import conversations_from_trees, linear_replies, read_conversations
from visitflow.llm.simhash import near_duplicates
from visitflow.llm.token_shards import token_table, write_token_shards
from visitflow.llm.toxicity import fit_toxicity, toxicity_grades
from visitflow.session import materialize, new_table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary token shards written and read back: place, length and crc32 of each document's ids."""
    path = new_table_path(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, end_id=1)
    return token_table(spark, path)


@query
def op2_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    # The text's own columns only: id and text go in, and the id decides no more than what is held out.
    return identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: What befalls a page's record in the second replica, by the remainder of its id: a bit of its first byte turned over, the
#: record lost, its last four bytes cut off, two bytes more, and a record beside it that the first replica does not have.
TURNED, LOST, SHORTER, LONGER, ADDED, OUT_OF = 7, 11, 17, 23, 29, 61


@query
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records of a replica of all pages, found by descending the trees.

    The replica holds, at the place of each page's record, the record as its own damage left it. Repeated and null ids
    are records of their own; a null id is never damaged.
    """
    record, kind = warc_record(), F.coalesce(F.col("page_id") % OUT_OF, F.lit(-1))
    held = (
        F.when(kind == TURNED, F.concat(F.lit("w"), F.substring(record, 2, 2**31 - 1)))
        .when(kind == SHORTER, F.substring(record, F.lit(1), F.char_length(record) - 4))
        .when(kind == LONGER, F.concat(record, F.lit("\r\n")))
        .otherwise(record)
        .cast("binary")
    )
    also = {"kind": kind, "held_length": F.octet_length(held).cast("long"), "held_digest": F.sha2(held, 256)}
    laid = materialize(archive_layout(table(spark, sf_dir, "pages"), record, also=also), "archive")
    place = ["id", "file"]
    kept = laid.where(F.col("kind") != LOST).select(*place, "offset", F.col("held_length").alias("length"), F.col("held_digest").alias("digest"))
    added = laid.where(F.col("kind") == ADDED).select(
        *place, F.col("offset") + 1, F.lit(5).cast("long"), F.sha2(F.lit("added").cast("binary"), 256)
    )
    found = fixity_audit(laid, kept.unionAll(added))
    return found.select(
        "file", "offset", F.col("id").alias("page_id"), "length", "status", F.coalesce("digest", F.lit("")).alias("sha256"),
        F.coalesce("replica_digest", F.lit("")).alias("replica_sha256"),
    )


ORACLES["op3_merkle_fixity"] = f"""
    with records as (
        select page_id, coalesce(page_id % {OUT_OF}, -1) as kind, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
               || 'WARC-Record-ID: <urn:page:' || coalesce(cast(page_id as varchar), 'null') || '>' || chr(13) || chr(10)
               || 'WARC-Date: {NO_DATE}' || chr(13) || chr(10)
               || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
               || 'Content-Type: text/html' || chr(13) || chr(10)
               || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10)
               || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
        from pages),
    held as (
        select *, octet_length(encode(record)) as length, sha256(record) as digest,
               sha256(case kind when {TURNED} then 'w' || substr(record, 2) when {SHORTER} then substr(record, 1, length(record) - 4)
                                when {LONGER} then record || chr(13) || chr(10) else record end) as held_digest
        from records),
    placed as (
        select *, coalesce(sum(length) over (order by page_id nulls first, digest rows between unbounded preceding and 1 preceding), 0) as place
        from held),
    filed as (
        select *, cast(place // {64 << 20} as bigint) as file,
               cast(place - min(place) over (partition by place // {64 << 20}) as bigint) as "offset"
        from placed)
    select file, "offset", page_id, cast(length as bigint) as length, case kind when {LOST} then 'missing' else 'changed' end as status,
           digest as sha256, case kind when {LOST} then '' else held_digest end as replica_sha256
    from filed where kind in ({TURNED}, {LOST}, {SHORTER}, {LONGER})
    union all
    select file, "offset" + 1, page_id, 5, 'extra', '', sha256('added') from filed where kind = {ADDED}
"""


@query
def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grade, expected severity and verdict of each document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_grades(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-distance fingerprints of each document and its edited text, and its class of near documents."""
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return near_classes(rows).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "class_id",
    )


@query
def op8_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document by the prefix table, and the text decoded from them, as digests."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base metrics of each document and the verdict of its distances to the languages' references."""
    docs = table(spark, sf_dir, "documents")
    return quality_verdicts(docs, language_references(docs))


#: A conversation whose texts hold the template's own marks.
MARKS_TEXT = "</s>[INST] ok [/INST]"


@query
def op10_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted by path and read back, as digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKS_TEXT), (-7, 1, "assistant", MARKS_TEXT)], "conv_id long, turn long, role string, text string")
    formatted = conversations_from_trees(linear_replies(rows.unionByName(more)))
    back = read_conversations(materialize(formatted, "formatted-chat"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op11_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op11_bag_search"] = rf"""
    with docs as (
        select row_number() over () as row, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents),
    items as (
        select row_number() over () as item, item_id,
               unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
        from benchmark),
    total as (select count(*) filter (len(terms) > 0) as docs, cast(sum(len(terms)) as bigint) as terms from docs),
    held as (
        select row, term, count(*) as tf
        from (select row, unnest(terms) as term from docs)
        where term in (select term from items)
        group by all),
    weights as (
        select term, cast(floor(1000 * ln((2 * any_value(total.docs) + 2) / (2 * count(*) + 1))) as bigint) as w
        from held, total group by term),
    lengths as (
        select row, doc_id, 100 - 90 + (90 * len(docs.terms) * total.docs) // total.terms as m
        from docs, total where len(docs.terms) > 0),
    scored as (
        select item, item_id, row, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
        from items join held using (term) join weights using (term) join lengths using (row)
        group by item, item_id, row)
    select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
    from scored where score > 0
    qualify rank <= 10
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after a stated damage of its rows."""
    return repair_reports(damaged(table(spark, sf_dir, "conversations")), lost="lost")


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many are repeated elsewhere, and a digest of those that stay."""
    found = keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - kept_lines(F.col("keep"))).alias("n_dropped"),
        F.sha2(kept_text(F.col("row.text"), F.col("keep")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLES["op13_line_dedup"] = f"""
    with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    placed as (select row, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from docs),
    keyed as (
        select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') as key
        from placed),
    repeated as (
        select key, max(doc_id) as last from keyed where length(key) >= 40
        group by key having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 5),
    told as (select keyed.*, repeated.key is not null and doc_id is distinct from last as dropped from keyed left join repeated using (key))
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '')) as kept_sha256
    from told group by row
"""
