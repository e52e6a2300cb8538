"""The operators over their whole tables, with production parameters, and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import chat, exact_search, language, mixing, neighbours, packing, pages, phrases, quality, sharding, simhash, suffixes, whitening
from tallyhouse.llm.storage import new_folder, saved

TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").where(exact_search.finite("embedding")).select(
        F.col("vec_id").alias("id"), exact_search.whole_components("embedding", 256).alias("vec"))
    return exact_search.exact_top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered_conversations(_table(spark, folder, "conversations"))


def op4_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    found = suffixes.without_repeats(documents, ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pieces(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' pieces with the checksum of their ids in place of the ids, stored."""
    import public_tokenizers

    made = packing.tokenized(documents, columns, public_tokenizers.path(TOKENIZER))
    return saved(made.withColumn("ids_crc32", packing.ids_crc32()).drop("ids"), "pieces")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(pieces(_table(spark, folder, "documents"), ["doc_id"]))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identified(_table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbours.nearest(vectors, vectors.where("id % 50 = 0"), 5)


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    records = _table(spark, folder, "documents").select(
        "doc_id", sharding.record_size("text").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"))
    placed = sharding.sharded(records, "size", ["doc_id", "text_crc32", "size"], new_folder(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").alias("shard"),
                         F.col("_position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_pages(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "pages")
    texts = pages.main_texts(table, pages.learned(table), ["page_id", "url"])
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    return mixing.taken_words(documents, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whitening.usable(_table(spark, folder, "embeddings"), "vec_id", "embedding", 256)
    return whitening.whitened(vectors).withColumnRenamed("id", "vec_id")


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    forest = quality.learned(documents, labels.select("doc_id", F.col("quality").alias("label")))
    found = quality.scored(documents, forest, ["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "score", "predicted")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_exact_search": op1_exact_search,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_suffixes": op4_suffixes,
    "op5_packing": op5_packing,
    "op6_language": op6_language,
    "op7_neighbours": op7_neighbours,
    "op8_sharding": op8_sharding,
    "op9_pages": op9_pages,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op1_exact_search": """
        with whole as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), pairs as (
            select q.vec_id as query_id, c.vec_id, max(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))::bigint as score
            from whole q join whole c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v) group by all
        )
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
        from pairs qualify rank <= 5""",
    "op3_chat": """
        with told as (
            select coalesce('c' || conv_id, 'row ' || row_number() over ()) as conv, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
            from conversations
        ), turns as (
            select conv, conv_id, row_number() over (partition by conv order by turn nulls first, role, text) as position, role, text from told
        ), prefixes as (
            select conv, conv_id, position, count(*) over (partition by conv) as n_turns,
                string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over so_far as prefix,
                string_agg('<|' || role || '|>\n' || text || '<|end|>\n', '') over so_far as text
            from turns window so_far as (partition by conv order by position rows between unbounded preceding and current row)
        ), whole as (
            select n_turns, prefix, min(conv_id) as conv_id, min(text) as text from prefixes where position = n_turns group by all
        )
        select conv_id, n_turns, text from whole w
        where not exists (select 1 from prefixes p where p.position < p.n_turns and p.position = w.n_turns and p.prefix = w.prefix)""",
    "op13_phrases": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), worded as (
            select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
        ), grams as (
            select lang, 1 as size, unnest(w) as phrase from worded
            union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
            union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from worded
        ), counts as (
            select lang, size, phrase, count(*)::hugeint as f from grams group by all
        ), candidates as (
            select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counts where size > 1 and f >= 10
        ), cuts as (
            select lang, size, phrase, a, 1 as k, w[1] as head, array_to_string(w[2:], ' ') as tail from candidates
            union all select lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] from candidates where size = 3
        ), scores as (
            select c.lang, c.size, c.phrase, c.a, k, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f * y.f) as score
            from cuts c join counts x on x.lang = c.lang and x.phrase = c.head join counts y on y.lang = c.lang and y.phrase = c.tail
        ), worst as (
            select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1
        ), longer as (
            select lang, phrase, max(a) as most from (
                select lang, a, w[1] || ' ' || w[2] as phrase from candidates where size = 3
                union all select lang, a, w[2] || ' ' || w[3] from candidates where size = 3) group by all
        ), totals as (
            select lang, sum(f) as n from counts where size = 1 group by lang
        )
        select w.lang, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank,
            w.phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
        from worst w join totals using (lang) left join longer o on o.lang = w.lang and o.phrase = w.phrase
        where most is null or 100 * most < 50 * a
        qualify rank <= 2000""",
}
