"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from .chat import digests
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .html_text import html_text
from .minhash import near_duplicates
from .packing import pack, pieces
from .pii import replace_private
from .places import tokenizer
from .prefix_trie import regrouped, sequences, trie
from .quality import quality
from .scratch import table
from .spelling import variants, vocabulary
from .suffix_dedup import digests as removals
from .token_counts import token_counts
from .toxicity import toxicity


def op1_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_text(spark, sf_dir):
    return html_text(table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{tricky}' AS text")
    return digests(turns.unionByName(more))


def op6_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark, sf_dir):
    return removals(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    return pack(pieces(table(spark, sf_dir, "documents"), *tokenizer()))


def op9_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii_surrogates(spark, sf_dir):
    return replace_private(table(spark, sf_dir, "documents"), key="a key that the owner of the corpus keeps")


def op11_spelling_variants(spark, sf_dir):
    return variants(vocabulary(table(spark, sf_dir, "documents")))


def op12_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), *tokenizer())


def op13_prefix_trie(spark, sf_dir):
    return trie(regrouped(sequences(table(spark, sf_dir, "conversations"))))


_ALL = (op1_minhash_dedup, op2_exact_dedup, op3_toxicity, op4_html_text, op5_chat_formatting, op6_quality, op7_suffix_dedup, op8_best_fit_packing, op9_decontamination, op10_pii_surrogates, op11_spelling_variants, op12_token_counts, op13_prefix_trie)
QUERIES = {f.__name__: f for f in _ALL}

#: Of the SQL below: CRC-32 by a table of 256 numbers, and of a string of code points up to U+07FF.
_CRC_TABLE = """bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8)"""


def _crc(string: str) -> str:
    octets = f"flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END FOR x IN string_split({string}, '')])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}::BIGINT[]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


SQL = {
    "op1_minhash_dedup": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS low FROM t
  UNION
  SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b
), m AS (SELECT id, min(low) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = t.doc_id AS kept
FROM t JOIN m ON m.id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), w AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""",
    "op5_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, run)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (SELECT w, n, {_crc("id || ':' || w")} AS h FROM runs, crc),
v AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (
  SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS one_open, left(word, i - 1) || substr(word, i + 1) AS one_less FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.one_open = b.one_open AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON v.word = one_less
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON v.word = one_less
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS b FROM near GROUP BY 1
), named AS (
  SELECT word, CASE WHEN -b.less >= 10 * n THEN b.other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
  FROM v LEFT JOIN best USING (word)
), way(word, root) AS (
  SELECT word, word FROM named
  UNION ALL SELECT way.word, named.form FROM way JOIN named ON named.word = way.root WHERE named.form IS NOT NULL
)
SELECT a.word, a.form, way.root, a.n, a.n_near, a.form_n
FROM named a JOIN way ON way.word = a.word JOIN named z ON z.word = way.root WHERE z.form IS NULL
""",
    "op13_prefix_trie": rf"""
WITH RECURSIVE {_CRC_TABLE},
said AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS told, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, told, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, told, size) AS i FROM said
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc
), rebuilt AS (
  SELECT c.conv_id, t.told, t.size, t.i - c.h AS place FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
  UNION ALL SELECT c.conv_id, t.told, t.size, t.i - 100 FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i <= c.h
), paths AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(told, '') OVER w AS path FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    CASE WHEN depth > 0 THEN left(path, length(path) - 64) END AS up
  FROM paths GROUP BY path, depth
), kids AS (SELECT up AS path, count(*) AS n_children FROM nodes GROUP BY 1),
below AS (
  SELECT a.path, sum(CASE WHEN k.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM nodes x LEFT JOIN kids k ON k.path = x.path JOIN paths a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY 1) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.path = n.up LEFT JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path LEFT JOIN ends e ON e.path = n.path
""",
}
