"""The queries of the training-data operators, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import table
from factorloom.llm.conversations import conversation_digests, repair_conversations
from factorloom.llm.fingerprint import FIRST, fingerprints, likeness, with_edits
from factorloom.llm.line_rules import clean_lines
from factorloom.llm.mixing import mix_sources
from factorloom.llm.near_dedup import near_duplicates
from factorloom.llm.ngram_join import ngram_join
from factorloom.llm.packing import pack_documents
from factorloom.llm.quality_model import fit_quality, held_out, score_quality
from factorloom.llm.secret_scan import scan_secrets
from factorloom.llm.spelling import runs, spelling_variants
from factorloom.llm.substring_dedup import remove_repeats
from factorloom.llm.token_files import fresh_folder, read_tokens, write_tokens
from factorloom.llm.tokens import default_vocabulary
from factorloom.llm.url_filter import Rule, filter_urls

PAGE_RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


#: Documents with a lower score are predicted bad.
QUALITY_CUT = 0.3


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), capacity=2048, end_id=0)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, following = with_edits(table(spark, sf_dir, "documents"))
    rows = rows.select("__key", "text", "edited", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    made = fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint"})
    after = made.groupBy("__key").agg(F.min("fingerprint").alias("__after")).withColumnRenamed("__key", "__next")
    pairs = made.join(following.join(after, "__next").select("__key", "__after"), "__key")
    return pairs.select(
        F.nullif("__key", F.lit(FIRST)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__after")).alias("near_next"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, fresh_folder(docs), default_vocabulary(), end_id=2))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), match=50)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM docs
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n >= 2
), repeats AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM split)
), judged AS (
  SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
    (n < 5 AND NOT regexp_matches(line, '[.!?:;,"'')\]…。！？-][\x20\x09-\x0D]*$'))
    OR (len(regexp_extract_all(line, '[|»›•·]')) >= 2 AND len(regexp_extract_all(line, '[|»›•·]')) * 4 >= n)
    OR regexp_matches(line, '(?i)(all rights reserved|copyright|licen[cs]ed under|terms of (use|service)|privacy policy|cookie policy|use[sd]? cookies|enable javascript|click here|read more|sign up|log in|subscribe to|share this|skip to (main )?content|back to top|lorem ipsum)')
    OR len(regexp_extract_all(line, '[#*$%&|<>]{2,}')) * 3 >= n
    OR len(regexp_extract_all(line, '!!')) * 3 >= n
    OR (n >= 10 AND len(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) * 3 <= n) AS fails
  FROM lines WHERE n > 0
), by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (NOT fails), 0) AS kept_chars FROM judged GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
  FROM split s LEFT JOIN repeats r USING (doc_id) LEFT JOIN by_doc b USING (doc_id)
), failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= 50 * word_chars AS kept FROM failed
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


OP9_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), use=~held_out())
    predicted = (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted")
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), PAGE_RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def damaged(turns: DataFrame) -> DataFrame:
    """The query's own damage: by the checksum of ``conv_id:turn``, turns go, lose text or stops, come twice, or change role."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found, repaired = repair_conversations(damaged(turns))
    digests = conversation_digests(repaired)
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id")
    rows = rows.join(digests, F.col("id").eqNullSafe(digests["conv_id"]), "left").drop("conv_id")
    none = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *none, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# Costs from each state to the end, from the last turn to the first; then the least letter of the tight ones, from the first on.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(n))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS b FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295) % 20 AS kind FROM keyed, crc
), broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM broken)
), faults AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[ 	-
]*') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] WHEN role = '' THEN 'e' ELSE 'o' END AS c, lag(CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] WHEN role = '' THEN 'e' ELSE 'o' END) OVER (PARTITION BY conv_id ORDER BY p) AS last FROM placed
), rows AS (
  SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS x FROM faults
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (last || c NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM rows GROUP BY conv_id
), ahead(conv_id, p, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, 0, 10, 5, 0 FROM totals
  UNION ALL
  SELECT conv_id, p, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT r.conv_id, r.p,
      least(2 + v0, CASE WHEN free THEN least(x + CASE c WHEN 's' THEN v1 WHEN 'u' THEN v2 WHEN 'e' THEN v0 ELSE 1000000 END, 1 + x + v2) ELSE 1000000 END) AS b0,
      least(2 + v1, CASE WHEN free THEN least(x + CASE c WHEN 'u' THEN v2 WHEN 'e' THEN v1 ELSE 1000000 END, 1 + x + v2) ELSE 1000000 END) AS b1,
      least(2 + v2, CASE WHEN free THEN least(x + CASE c WHEN 'a' THEN v3 WHEN 'e' THEN v2 ELSE 1000000 END, 1 + x + v3) ELSE 1000000 END) AS b2,
      least(2 + v3, CASE WHEN free THEN least(x + CASE c WHEN 'u' THEN v2 WHEN 'e' THEN v3 ELSE 1000000 END, 1 + x + v2) ELSE 1000000 END) AS b3
    FROM ahead a JOIN rows r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.p = a.p - 1)
), steps AS (
  SELECT r.*, [a.v0, a.v1, a.v2, a.v3] AS v, [z.v0, z.v1, z.v2, z.v3] AS w FROM rows r
  JOIN ahead a ON a.conv_id IS NOT DISTINCT FROM r.conv_id AND a.p = r.p JOIN ahead z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.p = r.p + 1
), walk(conv_id, p, s, audit, done) AS (
  SELECT conv_id, 1::BIGINT, 0, '', '' FROM totals
  UNION ALL
  SELECT conv_id, p + (e <> 'I')::INT, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE forced END, audit || e,
    done || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE forced WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT *, CASE WHEN p > n THEN 'I' WHEN v[s + 1] = 2 + w[s + 1] THEN 'D' WHEN v[s + 1] = 5 + v[forced + 1] THEN 'I' WHEN free AND kept IS NOT NULL AND v[s + 1] = x + w[kept + 1] THEN 'K' ELSE 'R' END AS e
    FROM (SELECT k.*, t.n, q.role, q.text, q.free, q.x, q.v, q.w, CASE s WHEN 2 THEN 3 ELSE 2 END AS forced,
            CASE WHEN c = 'e' THEN s WHEN c = 's' AND s = 0 THEN 1 WHEN c = 'u' AND s <> 2 THEN 2 WHEN c = 'a' AND s = 2 THEN 3 END AS kept
          FROM walk k JOIN totals t ON t.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN steps q ON q.conv_id IS NOT DISTINCT FROM k.conv_id AND q.p = k.p
          WHERE k.p <= t.n OR k.s IN (1, 2)))
), ends AS (
  SELECT k.conv_id, audit, done FROM walk k JOIN totals t ON t.conv_id IS NOT DISTINCT FROM k.conv_id WHERE k.p > t.n AND k.s IN (0, 3)
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(substr(coalesce(done, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ahead a ON a.conv_id IS NOT DISTINCT FROM i.conv_id AND a.p = 1 LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def misspelt(docs: DataFrame, shortest: int) -> DataFrame:
    """word: the runs of letters, of which the query's own damage takes one code point away where 31 divides the checksum."""
    rows = runs(docs, shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(misspelt(table(spark, sf_dir, "documents"), 7), shortest=7, at_least=2, ratio=10)


# Near words by what is left when a code point goes: at one place of both, or of the longer one.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce([n::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) r(n))
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS raw FROM documents
), counted AS (
  SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found WHERE length(raw) >= 7 GROUP BY 1, 2
), bytes AS (
  SELECT run, n, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))) AS b FROM counted
), hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295) AS h FROM bytes, crc
), broken AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM broken WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(struct_pack(near := near, n := w.n) ORDER BY w.n DESC, near) AS b FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, form, c.root, f.n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word WHERE NOT EXISTS (SELECT 1 FROM forms g WHERE g.word = c.root AND g.form IS NOT NULL)
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), percent=90, width=3)


OP13_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_fingerprints": op2_fingerprints,
        "op3_mix_sources": op3_mix_sources,
        "op5_token_files": op5_token_files,
        "op4_secret_scans": op4_secret_scans,
        "op6_url_filters": op6_url_filters,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_line_rules": op8_line_rules,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_ngram_join": op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": OP6_SQL, "op8_line_rules": OP8_SQL, "op9_near_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_ngram_join": OP13_SQL}
