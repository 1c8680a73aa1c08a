"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tillpulse.llm import (
    decontaminate, edits, hmm, lines, merkle, mixing, packing, quality, search, secret_scan, sharding, simhash, warc
)
from tillpulse.llm.common import read_table, stored

SHARDS = 40


def op1_secret_scan(spark, sf_dir):
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secret_scan.BASE_RULES]

    def of(*wanted):
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(secret_scan.joined(of(*kinds)).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op2_warc(spark, sf_dir):
    archives = warc.write_archives(read_table(spark, sf_dir, "pages"))
    found = warc.read_archives(archives, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_pack(spark, sf_dir):
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_hidden_markov(spark, sf_dir):
    return hmm.hidden_markov_scores(read_table(spark, sf_dir, "documents"))


def op5_repeated_units(spark, sf_dir):
    found = lines.repeated_units(read_table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s["starts"].cast("string"), s["ends"].cast("string")))
    return found.select(
        "doc_id", "n_units", F.size("starts").cast("long").alias("n_removed"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w).alias("removed_words"),
        F.concat_ws(",", spans).alias("spans"),
        F.concat_ws(",", F.array_sort(F.array_distinct("first_docs")).cast("array<string>")).alias("first_docs"),
    )


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op7_decontaminate(spark, sf_dir):
    report = decontaminate.decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.withColumn("items", F.concat_ws(",", F.col("items").cast("array<string>")))


def op8_quality_rules(spark, sf_dir):
    found = quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[F.col(f"statistics.{s}") for s in base], "base_failed", "kept")


_JUNK = re.compile(r"[#*$%&|<>]{2,}|[!?]{2,}|[ \t]{2,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Secrets masked, runs of symbols and marks removed, runs of blanks made one."""
    found = [(start, end, "[SECRET]") for _, start, end in secret_scan.find_spans(text)]
    return found + [(m.start(), m.end(), " " if m[0].isspace() else "") for m in _JUNK.finditer(text)]


def op9_edited_counts(spark, sf_dir):
    trees = stored(edits.counted(read_table(spark, sf_dir, "documents")), "token-trees")
    found = edits.edited(trees, cleaning_edits)
    return found.select("doc_id", "tokens_before", "tokens_after", "n_edits", "encoded_chars", F.char_length("text").cast("long").alias("chars_after"))


def op10_feistel_shards(spark, sf_dir):
    return sharding.feistel_shards(read_table(spark, sf_dir, "documents"), SHARDS).drop("row_number", "position")


def op11_mix_sources(spark, sf_dir):
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read_table(spark, sf_dir, "documents")).drop("steps")


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_warc, op3_pack, op4_hidden_markov, op5_repeated_units, op6_simhash, op7_decontaminate, op8_quality_rules, op9_edited_counts, op10_feistel_shards,
    op11_mix_sources, op12_ranked_search, op13_merkle_manifest,
)}

ORACLE: dict[str, str] = {
    "op2_warc": """
        with rows as (
            select page_id, url, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest from pages
        ), holders as (
            select digest, max(page_id) as holder, count(*) as copies from rows
            where strlen(payload) >= 1000 group by digest
        )
        select page_id, cast(strlen(payload) as bigint) as payload_bytes, rows.digest as payload_digest,
               case when copies > 1 and page_id < holder then 'revisit' else 'response' end as record_type,
               case when copies > 1 and page_id < holder then holder end as refers_to, url
        from rows left join holders on rows.digest = holders.digest
    """,
    "op7_decontaminate": r"""
        with texts as (
            select 'd' as side, doc_id as id, coalesce(text, '') as text from documents
            union all select 'b', item_id, coalesce(text, '') from benchmark
        ), words as (
            select side, id, list_filter(string_split(regexp_replace(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x01-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda w: w <> '') as w
            from texts
        ), spans as (
            -- An item of fewer words than five is one shingle of all its words; documents have shingles of those lengths too.
            select distinct least(len(w), 5) as n from words where side = 'b' and len(w) > 0
        ), shingles as (
            select distinct side, id, unnest(list_transform(
                range(1, len(w) - n + 2), lambda i: list_aggregate(w[i:i + n - 1], 'string_agg', ' '))) as shingle
            from words join spans on len(w) >= n and (side = 'd' or n = least(len(w), 5))
        ), sizes as (select id as item_id, count(*) as size from shingles where side = 'b' group by id),
        named as (
            select min(item_id) as item_id, any_value(size) as size from sizes
            join words on side = 'b' and words.id = item_id group by w
        ), shared as (
            select d.id as doc_id, b.id as item_id, count(*) as shared
            from shingles d join shingles b on d.shingle = b.shingle and d.side = 'd' and b.side = 'b' group by all
        ), found as (
            select doc_id, list(item_id order by item_id) as items, max(shared / size) as containment
            from shared join named using (item_id) where shared / size >= 0.8 group by doc_id
        )
        select documents.doc_id, found.doc_id is not null as contaminated, cast(coalesce(len(items), 0) as integer) as n_items,
               coalesce(list_aggregate(items, 'string_agg', ','), '') as items, containment
        from documents left join found on documents.doc_id = found.doc_id
    """,
    "op12_ranked_search": r"""
        with d as (
            select row_number() over () as row, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents
        ), used as (select * from d where len(words) > 0),
        corpus as (select count(*) as docs, sum(len(words))::bigint as terms from used),
        postings as (
            select row, doc_id, len(words)::bigint as n, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
            from (select row, doc_id, words, unnest(words) as word from used)
        ), tf as (select row, doc_id, n, term, count(*) as tf from postings group by all),
        df as (select term, count(*) as df from tf group by term),
        asked as (
            select item, item_id, term, count(*) as times from (
                select item, item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
                from (select row_number() over () as item, * from benchmark)) group by all
        ), weighed as (
            select item, item_id, term, times * floor(1000 * ln((2.0::double * docs + 2) / (2 * df + 1)))::bigint as weight
            from asked join df using (term) cross join corpus
        ), scores as (
            select item, item_id, row, doc_id,
                   sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
            from weighed join tf using (term) cross join corpus group by all
        ), best as (
            select *, row_number() over (partition by item order by score desc, doc_id nulls first) as rank from scores where score > 0
        )
        select item_id, rank::integer as rank, doc_id, score from best where rank <= 10
    """,
    "op13_merkle_manifest": r"""
        with recursive rows as (
            select row_number() over () as row, doc_id, lang,
                case when doc_id is null then '-' else length(doc_id::varchar) || ':' || doc_id end
                || case when source is null then '-' else strlen(source) || ':' || source end
                || case when lang is null then '-' else strlen(lang) || ':' || lang end
                || case when n_chars is null then '-' else length(n_chars::varchar) || ':' || n_chars end as head,
                text,
                xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
                    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)::ubigint[]),
                        lambda x, _: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))), 4294967295::ubigint) % 3 = 0 as tampered
            from documents
        ), leaves as (
            select row, doc_id, lang, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
                case when tampered then sha256(head || case when text is null then '-' else strlen(text) || ':'
                    || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end) end as changed
            from rows
        ), ranked as (
            select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by lang) as n
            from leaves
        ), nodes as (
            select 0 as level, lang, n, rank, leaf as digest from ranked
            union all
            select level + 1, lang, n, rank // 8, sha256(string_agg(digest, '' order by rank)) from nodes
            where n > 8 ** level group by level, lang, n, rank // 8
        ), subroots as (
            select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as rank, count(*) over () as n
            from nodes where level = (case when n = 1 then 0 else ceil(round(log(n) / log(8), 9)) end)
        ), tops as (
            select 0 as level, n, rank, subroot as digest from subroots
            union all
            select level + 1, n, rank // 8, sha256(string_agg(digest, '' order by rank)) from tops
            where n > 8 ** level group by level, n, rank // 8
        ), root as (select digest as root from tops order by level desc limit 1),
        every as (
            select level, coalesce(lang, '-') as tree, lang is null as none, rank, digest, n from nodes
            union all select level, null, null, rank, digest, n from tops
        ), runs as (
            select level, tree, none, rank // 8 as run, list(digest order by rank) as digests from every where n > 8 ** level group by all
        ), steps as (
            select row, 0 as part, level, list_aggregate(digests[1:(rank // (8 ** level)::bigint) % 8], 'string_agg', '') as before,
                   list_aggregate(digests[(rank // (8 ** level)::bigint) % 8 + 2:], 'string_agg', '') as after
            from ranked join runs on run = rank // (8 ** (level + 1))::bigint and tree = coalesce(lang, '-') and none = (lang is null)
            union all
            select row, 1, level, list_aggregate(digests[1:(subroots.rank // (8 ** level)::bigint) % 8], 'string_agg', ''),
                   list_aggregate(digests[(subroots.rank // (8 ** level)::bigint) % 8 + 2:], 'string_agg', '')
            from ranked join subroots on ranked.lang is not distinct from subroots.lang
                join runs on run = subroots.rank // (8 ** (level + 1))::bigint and tree is null
        ), proofs as (
            select row, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' order by part, level)) as proof,
                   list([coalesce(before, ''), coalesce(after, '')] order by part, level) as path from steps group by row
        ), folded as (
            select row, 0::bigint as done, coalesce(changed, leaf) as node from ranked
            union all
            select row, done + 1, sha256(path[done + 1][1] || node || path[done + 1][2]) from folded join proofs using (row) where done < len(path)
        )
        select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) as proof_sha256, node as folded_root, node = root as verified
        from ranked join subroots on ranked.lang is not distinct from subroots.lang cross join root left join proofs using (row)
            join (select row, arg_max(node, done) as node from folded group by row) using (row)
    """,
}
