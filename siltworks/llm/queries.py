"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltworks.llm import bpe, chat, collocations, exact, language, leaks, lines, packing, pii, simhash, tokens, toxicity, turns
from siltworks.llm.common import table

COUNT_FILE, RANK_FILE, PACK_FILE = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, folder))


PROBE = r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(chat.format_turns(chat.text_parts(turns.unionByName(probe))))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder), public_tokenizers.path(COUNT_FILE), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(documents(spark, folder), table(spark, folder, "benchmark"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.identify(docs, language.fit(docs))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, folder))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(documents(spark, folder))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair(turns.damaged(table(spark, folder, "conversations")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path(PACK_FILE))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_best_fit_packing": op13_best_fit_packing,
}

ORACLES = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), c AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\x02\x03\x1b\x0e\x0f]', '', 'g')) + length(role) + 3 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    # one edit: the halves before or behind it are equal
    "op10_line_dedup": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(s) AS raw
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)) AS s FROM documents)
), o AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(raw, ' ') AS line FROM l WHERE length(trim(raw, ' ')) >= 20),
d AS (SELECT line, length(line) AS n FROM o GROUP BY line),
k AS (
  SELECT line, n, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS piece
  FROM d, LATERAL (SELECT unnest([n, n - 1]) AS m), LATERAL (SELECT unnest([0, 1]) AS side)
), p AS (
  SELECT DISTINCT x.line AS x, y.line AS y FROM k x JOIN k y ON x.m = y.m AND x.side = y.side AND x.piece = y.piece
  WHERE x.n = x.m AND (y.n > x.n OR y.line > x.line)
), e AS (
  SELECT x, y FROM p WHERE CASE WHEN length(x) = length(y)
    THEN len(list_filter(range(1, length(x) + 1), lambda i: x[i] <> y[i])) <= 1
    ELSE len(list_filter(range(1, length(y) + 1), lambda i: left(y, i - 1) || substr(y, i + 1) = x)) > 0 END
), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(line, other) AS (SELECT line, line FROM d UNION SELECT reach.line, b.y FROM reach JOIN both_ways b ON reach.other = b.x),
first AS (SELECT line, min(doc_id) AS doc_id FROM o GROUP BY line),
c AS (SELECT reach.line, min({'d': o.doc_id, 'l': o.line_no}) AS f FROM reach JOIN o ON o.line = reach.other GROUP BY reach.line),
n AS (SELECT x AS line, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT o.doc_id, o.line_no, f.d AS class_doc, f.l AS class_line, coalesce(n_links, 0) AS n_links,
       o.doc_id = f.d AND o.line_no = f.l AS kept
FROM o JOIN c USING (line) LEFT JOIN n USING (line)
""",
    # the rows of a conversation one after the other; s0 to s3: best edits so far that end at the start, behind s, u, a
    "op11_conversation_repair": r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS name
  FROM conversations
), bits AS (
  SELECT *, list_prepend(4294967295, flatten(list_transform(range(octet_length(name)),
         lambda i: [CAST(ord(decode(name[i + 1:i + 1])) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS b FROM raw
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(b, lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1)))) % 20 AS kind FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         CASE role WHEN '' THEN ' ' ELSE left(role, 1) END AS c,
         right(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'), 1) AS last FROM damaged
), faults AS (
  SELECT *, last = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed
), judged AS (
  SELECT *, blank OR again AS lost, CASE WHEN NOT blank AND NOT again AND last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM faults
), counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (more = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), first AS (SELECT {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS s0, {'c': 1000000000, 'a': '', 'o': CAST([] AS VARCHAR[])} AS no
), steps AS (
  SELECT conv_id, 0 AS i, s0, no AS s1, {'c': 3, 'a': 'I', 'o': ['user:']} AS s2, {'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']} AS s3 FROM counts, first
  UNION ALL
  SELECT conv_id, i, s0, s1, t2, least(t3, {'c': t2.c + 3, 'a': t2.a || 'I', 'o': list_append(t2.o, 'assistant:')}) FROM (
    SELECT conv_id, i, s0, s1, m3 AS t3,
           least(m2, {'c': s0.c + 3, 'a': s0.a || 'I', 'o': list_append(s0.o, 'user:')}, {'c': s1.c + 3, 'a': s1.a || 'I', 'o': list_append(s1.o, 'user:')},
                 {'c': m3.c + 3, 'a': m3.a || 'I', 'o': list_append(m3.o, 'user:')}) AS t2
    FROM (
      SELECT s.conv_id, r.i,
        {'c': s.s0.c + 4, 'a': s.s0.a || 'D', 'o': s.s0.o} AS s0,
        least({'c': s.s1.c + 4, 'a': s.s1.a || 'D', 'o': s.s1.o},
              {'c': s.s0.c + CASE WHEN NOT lost AND c = 's' THEN more ELSE 1000000000 END, 'a': s.s0.a || 'K', 'o': list_append(s.s0.o, role || ':' || text)}) AS s1,
        least({'c': s.s2.c + 4, 'a': s.s2.a || 'D', 'o': s.s2.o},
              {'c': s.s0.c + keep_u, 'a': s.s0.a || 'K', 'o': list_append(s.s0.o, role || ':' || text)}, {'c': s.s0.c + other, 'a': s.s0.a || 'R', 'o': list_append(s.s0.o, 'user:' || text)},
              {'c': s.s1.c + keep_u, 'a': s.s1.a || 'K', 'o': list_append(s.s1.o, role || ':' || text)}, {'c': s.s1.c + other, 'a': s.s1.a || 'R', 'o': list_append(s.s1.o, 'user:' || text)},
              {'c': s.s3.c + keep_u, 'a': s.s3.a || 'K', 'o': list_append(s.s3.o, role || ':' || text)}, {'c': s.s3.c + other, 'a': s.s3.a || 'R', 'o': list_append(s.s3.o, 'user:' || text)}) AS m2,
        least({'c': s.s3.c + 4, 'a': s.s3.a || 'D', 'o': s.s3.o},
              {'c': s.s2.c + CASE WHEN NOT lost AND c = 'a' THEN more ELSE 1000000000 END, 'a': s.s2.a || 'K', 'o': list_append(s.s2.o, role || ':' || text)},
              {'c': s.s2.c + other, 'a': s.s2.a || 'R', 'o': list_append(s.s2.o, 'assistant:' || text)}) AS m3
      FROM steps s JOIN (
        SELECT *, CASE WHEN lost THEN 1000000000 ELSE 3 + more END AS other, CASE WHEN NOT lost AND c = 'u' THEN more ELSE 1000000000 END AS keep_u FROM judged
      ) r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
    )
  )
), best AS (SELECT steps.conv_id, least(s0, s3) AS b FROM steps JOIN counts ON counts.conv_id IS NOT DISTINCT FROM steps.conv_id AND steps.i = counts.n)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
longer AS (
  SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(w[2:k], ' '), a FROM c
), cuts AS (
  SELECT c.lang, c.phrase, c.a, s.k, l.f AS l, r.f AS r, CAST(n.n AS BIGINT) AS n,
         (CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM c, LATERAL (SELECT unnest(range(1, c.k)) AS k) s
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:s.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[s.k + 1:], ' ')
  JOIN n ON n.lang = c.lang
), weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts),
kept AS (
  SELECT * FROM weakest WHERE o = 1 AND NOT EXISTS (
    SELECT 1 FROM longer WHERE longer.lang = weakest.lang AND longer.phrase = weakest.phrase AND 100 * longer.a >= 100 * weakest.a)
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept
) WHERE rank <= 2000
""",
}
