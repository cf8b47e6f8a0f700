"""Registered queries of the training-data operators, and SQL twins where SQL can state them.

Each query applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetrisk.llm import (decontaminate, factorisation, jaccard, langid, licences, lines, minhash, mixing, phrases, quality,
                           repeats, search, sharding)
from fleetrisk.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(spark, sf_dir)``."""
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build
    return keep


#: Lower case for A-Z alone.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near_copies_sql(shingle: int, percent: int, more: str = "") -> str:
    """Links between distinct sets by their common shingles, and the smallest doc_id that links reach.

    Documents of one set are one node.
    """
    return f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(
         list_transform(range(1, len(w) - {shingle - 2}), lambda k: array_to_string(w[k:k + {shingle - 1}], ' ')))) END AS s FROM words),
classes AS (SELECT row_number() OVER () AS class, s, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
members AS (SELECT doc, doc_id, class FROM sets JOIN classes USING (s)),
grams AS (SELECT class, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT x.class AS x, y.class AS y FROM grams x JOIN grams y ON x.g = y.g AND x.class < y.class
  WHERE 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
  GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
  SELECT DISTINCT x AS class, x AS other FROM links
  UNION SELECT reach.class, links.y FROM reach JOIN links ON reach.other = links.x),
smallest AS (
  SELECT c.class, min(m.doc_id) AS component_id FROM (SELECT class, class AS other FROM classes UNION SELECT class, other FROM reach) c
  JOIN members m ON m.class = c.other GROUP BY c.class)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
       CASE WHEN len(s) = 0 THEN sets.doc_id ELSE component_id END AS component_id{more}
FROM sets LEFT JOIN members USING (doc) LEFT JOIN smallest USING (class)
"""


@query("op1_benchmark_decontamination")
def _op1(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_sharding")
def _op2(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op3_licence_scan")
def _op3(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard_join", _near_copies_sql(jaccard.SHINGLE, jaccard.PERCENT))
def _op4(spark, sf_dir):
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


_OP5 = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(3 * source_size AS DOUBLE) AS cap FROM per),
levels AS (
  SELECT *, row_number() OVER w AS place, cap / weight AS ratio,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, (SELECT arg_min(level, place) FROM levels WHERE level <= ratio) * weight), cap) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(least(3, epochs + CASE WHEN before + size / 2.0 < target - epochs * source_size
                                                           THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS copies FROM placed)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies
FROM taken
"""


@query("op5_mixing", _OP5)
def _op5(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@query("op6_line_dedup")
def _op6(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def _op7(spark, sf_dir):
    return factorisation.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_repeated_passages")
def _op8(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query("op9_quality_rules")
def _op9(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def _op10(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


_KEPT = ",\n       sets.doc_id IS NOT DISTINCT FROM CASE WHEN len(s) = 0 THEN sets.doc_id ELSE component_id END AS kept"


@query("op11_minhash_near_dedup", _near_copies_sql(minhash.SHINGLE, minhash.PERCENT, _KEPT))
def _op11(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_OP12 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT doc, doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
postings AS (SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY doc, term),
asked AS (SELECT item, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item, unnest(w) AS term FROM items) GROUP BY item, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * all_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM postings, corpus GROUP BY term, all_docs),
scored AS (
  SELECT item, doc, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc), corpus GROUP BY item, doc),
ranked AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored JOIN sizes USING (doc) WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item) WHERE place <= 10
"""


@query("op12_ranked_search", _OP12)
def _op12(spark, sf_dir):
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP13 = f"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM pieces),
grams AS (
  SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase FROM starts, (VALUES (1), (2), (3)) AS t(m) WHERE k + m - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
parts AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM parts),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer
  FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM counts WHERE m = 3)),
absorbed AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (
  SELECT x.*, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest x LEFT JOIN absorbed i ON i.lang = x.lang AND i.phrase = x.phrase
  WHERE place = 1 AND NOT coalesce(100 * longer >= 50 * a, false))
SELECT kept.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM kept JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_mining", _OP13)
def _op13(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
