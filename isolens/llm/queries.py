"""The queries over whole tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.llm import chat, decontamination, jaccard_join, mixing, pii, quality_rules, resampling, secret_scan, spans, toxicity, warc
from isolens.llm.scratch import table


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return spans.digests(found, [r.kind for r in secret_scan.BASE_RULES])


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.records_of(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.header_lines(F.col("headers")))


_CANONICAL = f"""CASE WHEN regexp_extract(url, '{warc.HOST_PATTERN}', 1) <> '' THEN lower(regexp_extract(url, '{warc.HOST_PATTERN}', 1))
    || CASE WHEN regexp_extract(url, '{warc.PORT_PATTERN}', 1) IN ('', '80', '443') THEN '' ELSE ':' || regexp_extract(url, '{warc.PORT_PATTERN}', 1) END
    || regexp_replace(regexp_extract(url, '{warc.PATH_PATTERN}', 1), '/+$', '')
    || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END END"""
_PARAMS = f"list_sort(list_filter(string_split(regexp_extract(url, '{warc.QUERY_PATTERN}', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{warc.TRACKING_PATTERN}')))"
_TAGS = {"W/tag": "tag", "tag": "tag", "other": "'\"other\"'", None: "NULL"}


def _revisit_rows() -> str:
    rows = []
    for i, (name, every, after, etag, modified) in enumerate(warc.REVISITS, 1):
        url = "'https://nowhere.example/' || page_id" if name == "nowhere" else "regexp_replace(url, '#.*$', '') || '#again'"
        rows.append(f"SELECT page_id * 8 + {i}, {url}, page_id * 100 + {after}, {_TAGS[etag]}, {'date' if modified else 'NULL'}, page_id, '{name}', '{'W/' if etag == 'W/tag' else ''}' FROM p WHERE page_id % {every} = 0")
    return " UNION ALL ".join(rows)


#: ASOF JOIN, which takes the latest response up to the revisit's time; no two records of a page share a time.
OP4_SQL = f"""WITH p AS (SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id % 30) AS date FROM pages),
    full_ AS (SELECT page_id * 8 AS record_id, url, page_id * 100 AS ts, tag, date, page_id FROM p),
    again AS (SELECT * FROM ({_revisit_rows()}) AS r(record_id, url, ts, tag, date, page_id, name, weak)),
    f AS (SELECT *, {_CANONICAL} AS canonical_url FROM (SELECT *, {_PARAMS} AS params FROM full_)),
    a AS (SELECT *, {_CANONICAL} AS canonical_url FROM (SELECT *, {_PARAMS} AS params FROM again)),
    j AS (SELECT a.*, f.record_id AS response_id, f.tag AS old_tag, f.date AS old_date FROM a ASOF LEFT JOIN f ON a.canonical_url = f.canonical_url AND a.ts >= f.ts),
    o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag IS NULL AND date IS NULL THEN 'no_validator'
        WHEN coalesce(CASE WHEN tag IS NOT NULL THEN tag = old_tag ELSE date = old_date END, false) THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
    SELECT record_id, canonical_url, response_id, outcome, CASE WHEN outcome = 'resolved' THEN
        'content-type: text/html' || chr(10) || 'date: again ' || page_id || chr(10) || 'etag: ' || CASE WHEN tag IS NOT NULL THEN weak || tag ELSE old_tag END || chr(10) || 'expires: ' || name || chr(10) || 'last-modified: ' || old_date END AS headers FROM o"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("scores", lambda x: F.format_number(x, 2)), ",").alias("scores")
    return spans.digests(found, [k.name for k in pii.BASE], (scores,))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(turns.unionByName(chat.control_sample(turns))))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SAID = "<|im_end|><|im_start|>assistant ok"
OP7_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        sum({len(chat.OPEN)} + length(role) + len(regexp_extract_all(role, '[\x1e\n]')) + 1 + length(text) + len(regexp_extract_all(text, '<\x1f*[|]')) + {len(chat.CLOSE)}) AS formatted FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), n=4, least=85)


#: All pairs that share a shingle are counted, and components are followed to their smallest id.
OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
    g AS (SELECT doc_id, i, n, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS gram FROM p WHERE n >= 4 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    u AS (SELECT DISTINCT doc_id, hash(gram) AS h FROM g WHERE gram IS NOT NULL UNION SELECT doc_id, hash(array_to_string(words, ' ')) FROM w WHERE len(words) BETWEEN 1 AND 3),
    n AS (SELECT doc_id, coalesce(k, 0) AS n_shingles FROM w LEFT JOIN (SELECT doc_id, count(*) AS k FROM u GROUP BY 1) USING (doc_id)),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
    reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
    SELECT n.doc_id, n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_resampling, op3_secret_scan, op4_revisits, op5_decontamination, op6_pii, op7_chat_format, op8_toxicity, op9_quality_rules, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {"op4_revisits": OP4_SQL, "op7_chat_format": OP7_SQL, "op10_jaccard_join": OP10_SQL}
