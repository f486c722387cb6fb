"""The query of each operator over the driver's tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import find_leaks, hit_words
from tessera.llm.exact_dedup import dedup_exact
from tessera.llm.hidden_markov import score_documents
from tessera.llm.line_dedup import text_classes
from tessera.llm.mixing import mix_sources
from tessera.llm.repeats import remove_repeats
from tessera.llm.shared import id_fold, table
from tessera.llm.simhash import hex_print, near_duplicates
from tessera.llm.toxicity import learn, score_texts
from tessera.llm.url_filter import Rule, judge
from tessera.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), id_fold("doc_id", 5) == 1)


#: The rules of the page filter.
URL_RULES = [
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        F.col("words").cast("long").alias("n_words"),
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cols = ["doc_id", "n_lines", "n_removed", "n_links", F.coalesce("class_id", "doc_id").alias("class_id")]
    cols += [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("removed", "class_ids")]
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(*cols)


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2).select("doc_id", "toxic")
    scored = score_texts(docs, learn(docs, labels))
    predicted = F.when(F.col("score") >= 0.3, F.lit(1)).otherwise(F.lit(0))
    return scored.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "score", predicted.alias("predicted"), "hits")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_print().alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    "op1_hidden_markov": op1_hidden_markov,
    "op2_url_filters": op2_url_filters,
    "op3_warc": op3_warc,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM g
    """,
    "op4_benchmark_decontamination": r"""
        WITH words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
            FROM documents
        ), items AS (
            SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS window_text
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)
        ), lengths AS (SELECT DISTINCT m FROM windows),
        places AS (
            SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS window_text
            FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 1, 0) + 1)) AS p FROM words CROSS JOIN lengths)
        ), hits AS (SELECT doc_id, p, m, item_id FROM places JOIN windows USING (m, window_text)),
        hit_words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hits) GROUP BY doc_id),
        hit_items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM words d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
    """,
    "op5_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n_bytes, row_number() OVER () AS r FROM documents),
        w AS (SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n_bytes - 399)) AS p FROM d WHERE n_bytes >= 400)),
        twice AS (SELECT r, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        runs AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM
            (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM twice)),
        spans AS (SELECT r, run, min(p) AS a, max(p) + 400 AS z FROM runs GROUP BY r, run),
        cuts AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY z) AS z FROM spans GROUP BY r)
        SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
                lambda k: substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE z[k] END + 1, 2 * (CASE WHEN k = n_spans THEN n_bytes ELSE a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE z[k] END))), '') END)) AS kept_sha256
        FROM d LEFT JOIN cuts USING (r)
    """,
    # levenshtein counts bytes, so the letters of the tables beyond ASCII become one byte each
    "op6_line_dedup": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, n - 1 AS line_no, regexp_replace(l[n], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM docs)),
        kinds AS (SELECT line, length(line) AS points, min(ROW(doc_id, line_no)) AS first, row_number() OVER (ORDER BY min(ROW(doc_id, line_no))) AS k FROM lines WHERE line <> '' GROUP BY line),
        plain AS (SELECT *, translate(line, 'öüÖóÓäÜèéÍÊÄñÉßêçíÇÈÑ', concat(chr(1), chr(2), chr(3), chr(4), chr(5), chr(6), chr(7), chr(8), chr(14), chr(15), chr(16), chr(17), chr(18), chr(19), chr(20), chr(21), chr(22), chr(23), chr(24), chr(25), chr(26))) AS t FROM kinds),
        near AS (SELECT a.k AS a, b.k AS b FROM plain a JOIN plain b ON b.points BETWEEN a.points AND a.points + 2 AND (a.points < b.points OR a.k < b.k)
            WHERE b.points - a.points <= least(2, a.points // 10) AND a.points >= 10
            AND (substr(a.line, 1, a.points // 3) = substr(b.line, 1, a.points // 3) OR right(a.line, a.points // 3) = right(b.line, a.points // 3)
                OR contains(substr(b.line, greatest(1, a.points // 3 - 3), a.points - 2 * (a.points // 3) + 10), substr(a.line, a.points // 3 + 1, a.points - 2 * (a.points // 3))))
            AND levenshtein(a.t, b.t) <= least(2, a.points // 10)),
        both_ways AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reach AS (SELECT k, k AS r FROM kinds UNION SELECT reach.k, b FROM reach JOIN both_ways ON r = a),
        class AS (SELECT k, min(r) AS root FROM reach GROUP BY k),
        links AS (SELECT a AS k, count(*) AS links FROM both_ways GROUP BY a),
        known AS (SELECT x.line, coalesce(l.links, 0) AS links, y.first AS keep FROM kinds x JOIN class c ON c.k = x.k JOIN kinds y ON y.k = c.root LEFT JOIN links l ON l.k = x.k),
        judged AS (SELECT a.doc_id, a.line_no, coalesce(n.links, 0) AS links, n.keep, n.keep IS NOT NULL AND n.keep <> ROW(a.doc_id, a.line_no) AS gone FROM lines a LEFT JOIN known n ON a.line = n.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links, coalesce(min(struct_extract(keep, 1)), doc_id) AS class_id,
            coalesce(string_agg(line_no, ',' ORDER BY line_no) FILTER (WHERE gone), '') AS removed, coalesce(string_agg(struct_extract(keep, 1), ',' ORDER BY line_no) FILTER (WHERE gone), '') AS class_ids
        FROM judged GROUP BY doc_id
    """,
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            doc_id = first(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
    """,
    "op7_mixing_sources": r"""
        WITH base AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                md5('mix-1|' || CAST(doc_id AS VARCHAR)) AS place
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM base GROUP BY source
        ), w AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
        r AS (
            SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS ratio,
                CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w
        ), l AS (
            SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lev
            FROM r WINDOW b AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT *, least(weight * (SELECT arg_min(lev, (ratio, sid)) FROM l WHERE lev <= ratio), most) AS target,
                greatest(1, CAST(round(total / 32) AS BIGINT)) AS house, count(*) OVER () AS n
            FROM l
        ), q AS (SELECT *, CAST(floor(target / total * house + 0.5) AS BIGINT) AS seats FROM t),
        d AS (SELECT *, house - CAST(sum(seats) OVER () AS BIGINT) AS short FROM q),
        add_seats AS (
            SELECT sid, count(*) AS c FROM (
                SELECT sid, short, row_number() OVER (ORDER BY target / total / (2 * (seats + i) - 1) DESC, sid, i) AS k
                FROM d, range(1, 200) AS g(i) WHERE short > 0) WHERE k <= short GROUP BY sid
        ), cut_seats AS (
            SELECT sid, count(*) AS c FROM (
                SELECT sid, short, row_number() OVER (ORDER BY target / total / (2 * (seats - i + 1) - 1), sid DESC, i) AS k
                FROM d, range(1, 200) AS g(i) WHERE short < 0 AND i <= seats) WHERE k <= -short GROUP BY sid
        ), f AS (
            SELECT d.*, least((seats + coalesce(a.c, 0) - coalesce(c.c, 0)) * 32, source_size * 3) AS words
            FROM d LEFT JOIN add_seats a USING (sid) LEFT JOIN cut_seats c USING (sid)
        ), p AS (
            SELECT b.*, f.source_size, f.target, f.words,
                coalesce(sum(b.size) OVER (PARTITION BY f.sid ORDER BY place, doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM base b JOIN f ON b.source IS NOT DISTINCT FROM f.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
            CASE WHEN size = 0 THEN 0 ELSE CAST(size * (words // source_size) + greatest(0, least(size, words % source_size - start)) AS BIGINT) END AS taken
        FROM p
    """,
}
