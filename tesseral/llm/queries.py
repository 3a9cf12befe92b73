"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chat, read_back
from .decontaminate import contained
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .language_id import identify
from .near_dedup import near_dedup
from .sentencepiece_codec import encode
from .suffix_dedup import suffix_dedup
from .url_filter import url_filter
from .license_scan import NOTICES, PHRASES, license_scan


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    back = encode(docs, decoded="decoded")
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A log of list events. The pages carry no fetch time; a page counts as fetched on day 37 * page_id mod 366 of 2024.
LIST_EVENTS = [
    ("gambling", "casino-win.example.com", "2023-11-05", True),
    ("gambling", "casino-win.example.com", "2024-04-01", False),
    ("gambling", "casino-win.example.com", "2024-07-15", True),
    ("gambling", "free-bets.example.com", "2024-03-10", True),
    ("gambling", "free-bets.example.com", "2024-03-20", False),
    ("gambling", "free-bets.example.com", "2024-03-25", True),
    ("spam", "tionsh.example.com", "2024-02-01", True),
    ("spam", "tionsh.example.com", "2024-09-01", False),
    ("spam", "blog.tionsh.example.com", "2024-08-01", True),
    ("spam", "tiontion.example.net", "2024-01-01", True),
    ("spam", "tiontion.example.net", "2024-01-02", False),
    ("trial", "example.org", "2024-06-01", True),
    ("trial", "example.org", "2024-06-08", False),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame(LIST_EVENTS, "list string, pattern string, day string, listed boolean")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", fetched.alias("fetched"))
    return url_filter(captures, events).select("page_id", F.col("fetched").cast("string").alias("fetched"), "host", "lists", "n_entries", "blocked")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(turns.unionByName(planted)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_near_dedup": op4_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
}

_events = ", ".join(f"('{a}', '{b}', DATE '{c}', {d})" for a, b, c, d in LIST_EVENTS)
_templates = ", ".join(f"({k}, '{label}', {exact}, string_split('{text}', ' '))" for k, (label, text, exact) in enumerate([*((*x, True) for x in PHRASES), *((*x, False) for x in NOTICES)]))

SQL = {
    "op1_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
        p AS (SELECT doc_id, len(lines) AS n, i AS pos, lines[i] AS line, lines[i + 1] AS next FROM l, unnest(range(1, len(lines) + 1)) u(i)),
        w AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS again FROM p WHERE pos < n),
        g AS (
            SELECT p.doc_id, p.pos, p.line, coalesce(a.again, false) OR coalesce(b.again, false) AS gone
            FROM p LEFT JOIN w a ON a.doc_id = p.doc_id AND a.pos = p.pos LEFT JOIN w b ON b.doc_id = p.doc_id AND b.pos = p.pos - 1
        ), k AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
            FROM g GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents LEFT JOIN k USING (doc_id)""",
    "op2_language_id": r"""
        WITH crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), d AS (
            SELECT doc_id, lang, lower(coalesce(text, '')) AS low, text IS NOT NULL AS has_text,
                   coalesce(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 = 2, false) AS held_out
            FROM documents, crc
        ), w AS (SELECT doc_id, unnest(regexp_extract_all(low, '\p{L}+')) AS w FROM d),
        v AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
        k AS (
            SELECT doc_id, n, len(w) AS m, list_concat([CAST(1114112 AS BIGINT)], list_transform(string_split(w, ''), lambda c: CAST(unicode(c) AS BIGINT)), [CAST(1114112 AS BIGINT)]) AS c FROM v
        ), edges AS (
            -- the text's own edges: a word's last and the next word's first edge are one character, which no n-gram has in its middle
            SELECT doc_id, n, unnest(list_concat(
                list_transform(range(2, m + 2), lambda i: c[i]),
                list_transform(range(1, m + 2), lambda i: c[i] * 2097152 + c[i + 1]),
                list_transform(range(2, m + 2), lambda i: (c[i - 1] * 2097152 + c[i]) * 2097152 + c[i + 1]))) AS gram
            FROM k
        ), g AS (SELECT doc_id, gram, CAST(sum(n) AS BIGINT) AS n FROM edges GROUP BY ALL),
        p AS (
            SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place
            FROM (SELECT lang, gram, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY place < 300
        ), r AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS place FROM g QUALIFY place < 300),
        a AS (
            SELECT doc_id, l.lang, sum(CASE WHEN p.place IS NULL THEN 300 ELSE abs(p.place - r.place) END) AS apart, count(*) AS n
            FROM r CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = r.gram GROUP BY doc_id, l.lang
        ), b AS (SELECT doc_id, lang AS lang_pred, 1.0 - CAST(apart AS DOUBLE) / CAST(300 * n AS DOUBLE) AS score FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) = 1)
        SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(score, 0.0) AS score FROM d LEFT JOIN b USING (doc_id)""",
    "op3_license_scan": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), t(template, label, exact, tw) AS (VALUES {_templates}),
        spots AS (SELECT template, exact, len(tw) AS size, i AS t_pos, tw[i + 1:i + 3] AS gram FROM t, unnest(range(len(tw) - 2)) u(i)),
        grams AS (SELECT doc_id, i AS pos, w[i + 1:i + 3] AS gram FROM d, unnest(range(len(w) - 2)) u(i)),
        votes AS (
            SELECT doc_id, template, exact, size, pos - t_pos AS diagonal, count(DISTINCT pos) AS votes
            FROM grams JOIN spots USING (gram) GROUP BY ALL
        ), numbered AS (
            SELECT *, sum(gap) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster
            FROM (SELECT *, CASE WHEN exact THEN 1 WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS gap FROM votes)
        ), clusters AS (
            SELECT doc_id, template, exact, size, cluster, list(diagonal ORDER BY diagonal) AS diagonals, sum(votes) AS votes
            FROM numbered GROUP BY doc_id, template, exact, size, cluster
        ), checked AS (
            SELECT c.doc_id, t.label, t.exact, c.diagonals[1] AS start,
                   len(list_filter(range(len(tw)), lambda i: len(list_filter(diagonals, lambda d: i + d >= 0 AND i + d < len(w) AND w[i + d + 1] = tw[i + 1])) > 0)) / CAST(len(tw) AS DOUBLE) AS cover
            FROM clusters c JOIN d USING (doc_id) JOIN t USING (template)
            WHERE c.votes >= CASE WHEN c.exact THEN size - 2 ELSE greatest(2, size // 5) END
        ), verified AS (SELECT * FROM checked WHERE cover >= CASE WHEN exact THEN 1 ELSE 0.8 END),
        marks AS (
            SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
            FROM verified GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN marks USING (doc_id)""",
    "op4_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + least(len(w), 5) - 1], ' ')) AS gram FROM w, unnest(range(1, len(w) - least(len(w), 5) + 2)) u(k) WHERE len(w) > 0
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        c AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reach),
        m AS (SELECT doc_id, min(reach) AS component_id FROM c GROUP BY doc_id)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
        c AS (SELECT doc_id, o, substr(x, 2 * o + 1, 2098) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 1000)) AS o FROM d WHERE len(x) >= 100)),
        w AS (
            SELECT doc_id, o + unnest(range(least(1000, len(y) // 2 - 49))) AS i,
                   unnest(list_transform(range(least(1000, len(y) // 2 - 49)), lambda j: substr(y, 2 * j + 1, 100))) AS s
            FROM c
        ),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS found FROM w),
        h AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE found),
        g AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
        r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
        e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM r),
        k AS (
            SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
                   string_agg(substr(x, 2 * since + 1, 2 * (a - since)) || CASE WHEN final THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
            FROM e JOIN d USING (doc_id) GROUP BY doc_id
        )
        SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op7_url_filter": rf"""
        WITH e(list, pattern, day, listed) AS (VALUES {_events}),
        v AS (SELECT list, pattern, day AS since, listed, lead(day, 1, DATE '9999-12-31') OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM e),
        c AS (
            SELECT page_id, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day,
                   nullif(rtrim(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]+\]|[^/?#:@\[\]]+)', 1)), '.'), '') AS host
            FROM pages
        ), m AS (
            SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, count(*) AS n
            FROM c JOIN v ON (host = pattern OR ends_with(host, '.' || pattern) AND NOT regexp_matches(host, '^\[|^\d+(\.\d+){{3}}$')) AND listed AND since <= day AND day < until
            GROUP BY page_id
        )
        SELECT page_id, strftime(day, '%Y-%m-%d') AS fetched, host, coalesce(lists, '') AS lists, coalesce(n, 0) AS n_entries, lists IS NOT NULL AS blocked
        FROM c LEFT JOIN m USING (page_id)""",
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
        ), e AS (
            SELECT *, 19 + length(regexp_replace(role, '(\\*)(<turn>|<text>|</turn>|### Assistant:|### User:|### System:)', '\\\1\2', 'g'))
                   + length(regexp_replace(text, '(\\*)(<turn>|<text>|</turn>|### Assistant:|### User:|### System:)', '\\\1\2', 'g')) AS chars
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(len(w), 5) AS n, w[k:k + least(len(w), 5) - 1] AS gram FROM b, unnest(range(1, len(w) - least(len(w), 5) + 2)) u(k) WHERE len(w) > 0),
        q AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
        g AS (SELECT DISTINCT doc_id, n, w[k:k + n - 1] AS gram FROM d, (SELECT DISTINCT n FROM i) s, unnest(range(1, len(w) - n + 2)) u(k)),
        m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM g JOIN i USING (n, gram) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / CAST(n_item AS DOUBLE) AS containment
        FROM m JOIN q USING (item_id) WHERE 10 * n_shared >= 8 * n_item""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
