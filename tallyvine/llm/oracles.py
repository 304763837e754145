"""DuckDB SQL for the queries of the operators that SQL can express."""

from __future__ import annotations

from tallyvine.llm.queries import ANCHOR_EVERY, LABELS, MOVED_EVERY, QUERY_EVERY, UNWANTED_LABELS
from tallyvine.llm.topk import B, K1, K
from tallyvine.llm.url_filter import RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"


def top_k_search() -> str:
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), corpus AS (
  SELECT count(*) AS n, avg(len(w)) AS mean FROM words
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL
), known AS (
  SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1.0) AS idf
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), asked AS (
  SELECT doc_id AS query_id, term, idf FROM postings JOIN known USING (term) WHERE doc_id % {QUERY_EVERY} = 0
), scored AS (
  SELECT query_id, p.doc_id, sum(CAST(round(
    1e6 * idf * (tf * {K1 + 1}::DOUBLE) / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len(w) / mean))) AS BIGINT)) AS score
  FROM asked JOIN postings p USING (term) JOIN words USING (doc_id), corpus GROUP BY ALL
)
SELECT query_id, row_number() OVER best AS rank, doc_id, CAST(score AS BIGINT) AS score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, doc_id) QUALIFY rank <= {K}
"""


def quality_rules() -> str:
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, pos, w[pos:pos + 7] AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS pos FROM words WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, piece) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id
), measured AS (
  SELECT words.doc_id, text, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id)
), counted AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 10 * word_chars < 15 * n_words
    OR word_chars > 25 * n_words OR 100 * n_dup_lines > 40 * len(lines) OR 100 * capitals > 50 * word_chars) AS kept
FROM counted
"""


def url_filter() -> str:
    fits = [
        (text, verdict, f"(host = '{text.split('/')[0]}' OR ends_with(host, '.{text.split('/')[0]}')) "
         f"AND starts_with(path, '/{text.partition('/')[2]}')")
        for verdict, text in sorted(RULES, key=lambda x: -len(x[1]))
    ]
    rule = " ".join(f"WHEN {fit} THEN '{text}'" for text, _, fit in fits)
    verdict = " ".join(f"WHEN rule = '{text}' THEN '{kind}'" for text, kind, _ in fits)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), keyed AS (
  SELECT *, CASE {rule} END AS rule, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM keyed WHERE host <> '' AND regexp_matches(host, '(^|\\.)({"|".join(UNWANTED_LABELS)})-')
)
SELECT page_id, host, path, rule,
  CASE {verdict} WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM keyed
""".replace("\\\\", "\\")


def _linked(n: int) -> str:
    """Table expressions up to ``placed``: doc_id, n_shingles and component_id by word n-grams."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [w]
    ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i + {n - 1}]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT doc_id, s FROM shingles QUALIFY count(*) OVER (PARTITION BY s) > 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shared a JOIN shared b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other
), placed AS (
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
  FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
)
"""


def ngram_join() -> str:
    return _linked(5) + "SELECT * FROM placed"


def minhash() -> str:
    return _linked(4) + "SELECT *, doc_id = component_id AS kept FROM placed"


def hard_negatives() -> str:
    return f"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY rank <= 5
"""


def fill_in_middle() -> str:
    draws = ", ".join(f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, n, {draws} FROM texts
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


def registry() -> dict[str, str]:
    return {
        "op1_top_k_search": top_k_search(),
        "op3_quality_rules": quality_rules(),
        "op5_url_filter": url_filter(),
        "op6_ngram_join": ngram_join(),
        "op11_hard_negatives": hard_negatives(),
        "op12_minhash": minhash(),
        "op13_fill_in_middle": fill_in_middle(),
    }
