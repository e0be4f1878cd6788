"""Registered queries of the operators: each runs its operator over the whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import digests
from depvital.llm.common import new_folder, read_table
from depvital.llm.embedding_dedup import near_vectors
from depvital.llm.exact_dedup import exact_dedup
from depvital.llm.language_id import classify, fit, held_out
from depvital.llm.license_scan import AGREE, BASE, NOTICES, RARE_WORDS, license_labels, scan_licenses
from depvital.llm.line_dedup import line_dedup
from depvital.llm.mixing import BLOCK_DOCS, mix_sources
from depvital.llm.prefix_trie import borrowed_paths, ordered_turns, prefix_trie
from depvital.llm.sharding import shard
from depvital.llm.simhash import near_duplicates
from depvital.llm.token_counts import replace_matches, unbuilt
from depvital.llm.vector_codes import code_errors, compress
from depvital.llm.warc import archive_digests

#: Rank file of op3 and op8, an installed file of under one megabyte.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: op10's limit: what a loader reads at once.
SHARD_BYTES = 1 << 20
#: op8's edits: a run of one punctuation mark becomes a single one.
PUNCTUATION_RUN = r"([^\w\s])\1+"


def target_weight(source: Column, docs: Column) -> Column:
    """Targets of op6 and the pipeline: 1 to 9 parts for a source, whatever it holds, told by its name."""
    return 1 + F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 4), 16, 10).cast("long") % 9


#: op12's codes: parts of a vector, entries of a codebook, rounds.
VECTOR_PARTS, CODEBOOK_SIZE, LLOYD_ROUNDS = 8, 16, 6


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(read_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return classify(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"), target_weight)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of whole texts before and after runs of punctuation are cut to one mark."""
    state = unbuilt(read_table(spark, sf_dir, "documents"))
    edited = replace_matches(state, PUNCTUATION_RUN, r"\1", RANKS, public_tokenizers.PATTERN)
    return edited.select("doc_id", "n_tokens_before", "n_edits", "n_tokens", "split_again", F.sha2("text", 256).alias("text_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(scan_licenses(read_table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"), parts=VECTOR_PARTS, size=CODEBOOK_SIZE, rounds=LLOYD_ROUNDS)
    return code_errors(coded).withColumn("codebooks_sha256", F.lit(books.sha256()))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that begin with up to eight turns of the first of their family of five."""
    turns = ordered_turns(read_table(spark, sf_dir, "conversations"))
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return prefix_trie(borrowed_paths(turns, family=5, borrowed=borrowed, most=8))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_sharding": op10_sharding,
    "op11_license_scan": op11_license_scan,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}


def _lloyd_sql(parts: int, size: int, rounds: int) -> str:
    """All rounds as one chain of tables: e0, e1, ... entries; a0, a1, ... parts with their entry and distance."""
    steps = [
        f"""
        v AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS (
            SELECT r, part, w[part * (len(w) // {parts}) + 1 : (part + 1) * (len(w) // {parts})] AS x FROM v, range({parts}) AS t(part)
        ),
        e0 AS (SELECT part, r - 1 AS entry, x AS e FROM p WHERE r <= {size})"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, p.part, min_by(entry, (d, entry)) AS entry, min(d) AS d, any_value(x) AS x
            FROM (
                SELECT r, p.part, entry, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::BIGINT AS d
                FROM p JOIN e{i} ON p.part = e{i}.part
            ) AS p GROUP BY r, p.part
        )""")
        if i < rounds:
            steps.append(f"""
        e{i + 1} AS MATERIALIZED (
            SELECT e{i}.part, e{i}.entry, coalesce(m.e, e{i}.e) AS e FROM e{i} LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY place) AS e FROM (
                    SELECT part, entry, place, floor_div AS mean FROM (
                        SELECT part, entry, place, sum(c)::BIGINT AS s, count(*) AS n,
                            (sum(c)::BIGINT - ((sum(c)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
                        FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY ALL
                    )
                ) GROUP BY part, entry
            ) AS m ON m.part = e{i}.part AND m.entry = e{i}.entry
        )""")
    return f"""
        WITH {",".join(steps)},
        c AS (
            SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r
        ),
        h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS books FROM e{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256
        FROM v JOIN c USING (r), h
    """


def _template_rows() -> str:
    """Words of the licence templates as SQL rows (template, label, base, pos, word, in a key phrase)."""
    return ", ".join(
        f"({number}, '{t.label}', {t.base}, {pos}, '{word}', {pos in t.key_places})"
        for number, t in enumerate(BASE + NOTICES)
        for pos, word in enumerate(t.words)
    )


ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g ON d.text = g.text
    """,
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        g AS (SELECT payload, max(page_id) AS best FROM p WHERE strlen(payload) >= 1000 GROUP BY payload)
        SELECT page_id, strlen(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
            CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN best <> page_id THEN best END AS refers_to
        FROM p LEFT JOIN g ON p.payload = g.payload
    """,
    "op7_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ),
        k AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ),
        r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT k.*, r.first_doc IS NOT NULL AND r.first_doc <> k.doc_id AS lost FROM k LEFT JOIN r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op6_mixing": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, '') AS key,
                row_number() OVER (PARTITION BY source ORDER BY coalesce(md5(doc_id::VARCHAR), 'g' || md5(coalesce(text, '')))) - 1 AS n
            FROM documents
        ),
        w AS (SELECT key, any_value(1 + ('0x' || substr(md5(coalesce(source, '')), 1, 4))::BIGINT % 9) AS weight FROM d GROUP BY key),
        g AS (SELECT sum(weight)::BIGINT AS whole, list_reduce(list(weight), lambda a, b: gcd(a, b)) AS divisor FROM w),
        s AS (SELECT key, row_number() OVER (ORDER BY key) AS pos, whole // divisor AS period, weight // divisor AS share FROM w, g),
        q AS (SELECT list(share ORDER BY pos) AS q, max(period) AS period FROM s),
        r AS (
            SELECT -1::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS used, NULL::BIGINT AS best FROM q
            UNION ALL
            SELECT t + 1, list_transform(range(1, len(used) + 1), lambda i: used[i] + CASE WHEN i = b THEN 1 ELSE 0 END), b
            FROM (
                SELECT r.t, r.used, list_min(list_transform(range(1, len(q) + 1), lambda i: CASE
                    WHEN (used[i] * period) // q[i] <= t + 1
                    THEN (((used[i] + 1) * period + q[i] - 1) // q[i]) * 1000000 + i END)) % 1000000 AS b
                FROM r, q WHERE t + 1 < period
            )
        ),
        p AS (SELECT best AS pos, t AS slot, row_number() OVER (PARTITION BY best ORDER BY t) - 1 AS turn FROM r WHERE t >= 0),
        b AS (SELECT d.*, s.pos, s.period, s.share, n // {BLOCK_DOCS} AS block FROM d JOIN s ON d.key = s.key)
        SELECT doc_id, source, block, (block // share) * period + slot AS slot, n % {BLOCK_DOCS} AS place
        FROM b JOIN p ON b.pos = p.pos AND b.block % b.share = p.turn
    """,
    "op10_sharding": f"""
        WITH d AS (
            SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS hash
            FROM documents
        ),
        n AS (
            SELECT depth, hash >> (60 - depth) AS prefix, sum(bytes) AS bytes, count(*) AS docs
            FROM d, range(0, 41) AS t(depth) GROUP BY ALL
        ),
        leaf AS (
            SELECT n.* FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.prefix = n.prefix >> 1
            WHERE (n.depth = 0 OR up.bytes > {SHARD_BYTES}) AND (n.bytes <= {SHARD_BYTES} OR n.depth = 40)
        )
        SELECT d.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth, d.bytes,
            docs AS shard_docs, leaf.bytes AS shard_bytes, leaf.bytes > {SHARD_BYTES} AS over_limit
        FROM d JOIN leaf ON d.hash >> (60 - leaf.depth) = leaf.prefix
    """,
    "op11_license_scan": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT r, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM d
        ),
        tok AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS spot FROM w),
        tw(t, label, base, pos, word, key) AS (VALUES {_template_rows()}),
        df AS (SELECT word, count(DISTINCT r) AS n FROM tok WHERE word IN (SELECT word FROM tw) GROUP BY word),
        ranked AS (SELECT tw.*, n, row_number() OVER (PARTITION BY t ORDER BY n IS NULL, n, tw.word, pos) AS rnk FROM tw LEFT JOIN df USING (word)),
        flagged AS (SELECT *, n IS NOT NULL AND rnk <= {RARE_WORDS} AS rare FROM ranked),
        tpl AS (
            SELECT t, count(*) AS len, count(*) FILTER (WHERE key) AS keys,
                CASE WHEN bool_or(base) THEN count(*) FILTER (WHERE rare)
                    ELSE greatest(1, floor(count(*) FILTER (WHERE rare) * {AGREE} + 0.5)) END AS need
            FROM flagged GROUP BY t
        ),
        place AS (
            SELECT r, f.t, f.label, f.base, spot - pos AS start, count(*) AS same, count(*) FILTER (WHERE key) AS key_hits, count(*) FILTER (WHERE rare) AS votes
            FROM tok JOIN flagged f ON tok.word = f.word GROUP BY ALL
        ),
        found AS (
            SELECT r, label, base, start, same / len AS share FROM place JOIN tpl ON place.t = tpl.t WHERE key_hits = keys AND votes >= need
        ),
        agg AS (
            SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM found GROUP BY r
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
            last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM w LEFT JOIN agg USING (r)
    """,
    "op12_vector_codes": _lloyd_sql(VECTOR_PARTS, CODEBOOK_SIZE, LLOYD_ROUNDS),
    # crc32 bit by bit: a list of the identifier's bytes, each followed by eight steps
    "op13_prefix_trie": """
        WITH RECURSIVE t AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        v AS (
            SELECT c, list(struct_pack(role := role, text := text) ORDER BY pos) AS own,
                xor(4294967295, list_reduce(
                    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END
                )) % 9 AS h
            FROM t GROUP BY c
        ),
        p AS (
            SELECT v.c, list_concat(coalesce(b.own, [])[1 : v.h], v.own[v.h + 1 :]) AS path
            FROM v LEFT JOIN v AS b ON b.c = v.c - v.c % 5
        ),
        x AS (SELECT c, len(path) AS length, d, path[1 : d] AS prefix, CASE WHEN d > 0 THEN strlen(path[d].text) ELSE 0 END AS bytes FROM p, unnest(range(0, len(path) + 1)) AS u(d)),
        n AS (
            SELECT prefix, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE length = d), '')) AS ends_sha256
            FROM x GROUP BY prefix
        ),
        k AS (
            SELECT n.*, up.conv_id AS parent_conv_id, up.prefix AS up, coalesce(kids.n, 0) AS n_children
            FROM n LEFT JOIN n AS up ON n.depth > 0 AND up.prefix = n.prefix[1 : n.depth - 1]
            LEFT JOIN (SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL) AS kids ON kids.prefix = n.prefix
        ),
        below AS (
            SELECT prefix AS top, up AS next, n_children, (n_convs - 1) * bytes AS saved, prefix AS own FROM k
            UNION ALL
            SELECT k.prefix, k.up, below.n_children, below.saved, below.own FROM below JOIN k ON k.prefix = below.next
        ),
        s AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY top)
        SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
        FROM k JOIN s ON s.top = k.prefix
    """,
}
