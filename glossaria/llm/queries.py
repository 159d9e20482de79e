"""The queries of the thirteen operators over the driver's tables, and SQL where it can express one.

SQL can express neither fingerprints and trees of hashes (1, 5) nor tokenizers (2, 3, 9) nor trained models (6, 7, 8, 11)
nor eigenvectors (13): tests hold those against the tokenizers library, brute force in plain Python and numpy, pages whose
main text is known, and held-out labels. What of operators 1 and 7 SQL can express has queries of its own.
"""

from __future__ import annotations

import public_tokenizers

from .common import table, texts
from .exact_dedup import exact_dedup
from .html_extract import extract
from .language import languages
from .lexical_search import lexical_search
from .lexicon import encode_and_decode
from .minhash import fingerprints, near_duplicates
from .packing import packing
from .quality import quality
from .simhash import simhash
from .substring_dedup import substring_dedup
from .token_files import look_up, token_files, write_shards
from .url_filter import url_filter, url_parts
from .whitening import whiten

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD))


def op3_bpe(spark, sf_dir):
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op5_simhash(spark, sf_dir):
    return simhash(table(spark, sf_dir, "documents"))


def op6_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op7_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_language(spark, sf_dir):
    return languages(table(spark, sf_dir, "documents"))


def op12_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def near_duplicate_classes(spark, sf_dir):
    """Operator 1's bands and verified links over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def token_ids_by_key(spark, sf_dir):
    """Operator 9's files, asked for the ids of every document that has a label."""
    manifest = write_shards(texts(table(spark, sf_dir, "documents")), public_tokenizers.path(BYTE))
    return look_up(manifest, table(spark, sf_dir, "labels"))


def url_rules(spark, sf_dir):
    """Operator 7's hosts, paths and rules, without the model."""
    return url_parts(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_packing, op3_bpe, op4_substring_dedup, op5_simhash, op6_html, op7_url_filter, op8_quality, op9_token_files, op10_exact_dedup, op11_language, op12_search, op13_whitening, near_duplicate_classes, token_ids_by_key, url_rules)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"

ORACLE_SQL = {
    "op12_search": f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term, docs),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM d, c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""",
    "op4_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS k FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM later, range(20) AS r(j)),
every_word AS (SELECT doc_id, place, words[place] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(place)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept FROM every_word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""",
    "near_duplicate_classes": f"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, {_WORDS} AS words FROM t),
s AS (SELECT DISTINCT id, array_to_string(words[i : i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(2, len(words) - 3))) AS r(i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM pairs JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common)),
reach AS (SELECT id AS a, id AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, c.class_id FROM documents AS d JOIN t ON coalesce(d.text, '') = t.text JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY a) AS c ON c.a = t.id
""",
    "url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
FROM p
""",
}
