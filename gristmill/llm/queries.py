"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gristmill.llm import alignment, chat, covertree, credentials, dartminhash, decontaminate, language, mixing, resampling, substrings, tokencount, toxicity, urlfilter
from gristmill.llm.tables import table
from gristmill.plans.session import checkpoint

#: The vocabulary file of op9; any sentencepiece file can take its place.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: The vocabulary file of op3.
TURN_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The vocabulary files of op13.
ALIGNED = alignment.Tokenizers("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: The rules of op12.
URL_RULES = urlfilter.rules("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a builder under its function name."""

    def wrap(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return wrap


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY skey = '', skey COLLATE "binary") - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY skey),
lined AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER w AS place,
         coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM sources WINDOW w AS (ORDER BY source_size::DOUBLE / weight, skey)),
levels AS (
  SELECT place, (total::DOUBLE - 3.0 * used::DOUBLE) / (weights - spent)::DOUBLE AS level,
         weight, source_size FROM lined),
chosen AS (
  SELECT level FROM levels WHERE level * weight <= 3.0 * source_size ORDER BY place LIMIT 1),
planned AS (
  SELECT skey, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM chosen) * weight) AS target FROM sources),
budgets AS (
  SELECT *, floor(target)::BIGINT AS words,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds FROM planned),
tape AS (
  SELECT doc_id, skey, size, source_size, target, rounds, words - rounds * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key RANGE UNBOUNDED PRECEDING), 0) AS upto,
         sum(size) OVER (PARTITION BY skey, key) AS same
  FROM sized JOIN budgets USING (skey))
SELECT doc_id, size, source_size, target,
       (rounds * size + CASE WHEN rest > 0 AND upto < rest THEN size
                             WHEN rest > 0 AND upto - same < rest THEN size * (rest - upto + same) // same
                             ELSE 0 END)::BIGINT AS taken
FROM tape
"""


@query(MIX_SQL.replace('COLLATE "binary"', ""))
def op4_mix_sources(spark, sf):
    """All documents, weights 1, 2, 3 by source, all words shared out, at most three rounds."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_decontaminate(spark, sf):
    """Every passage of every document against all benchmark items."""
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "best_score")


@query()
def op7_near_duplicates(spark, sf):
    """Classes of all documents at a similarity of 0.8 on five-word runs."""
    return dartminhash.near_duplicates(table(spark, sf, "documents"))


def secret_sql() -> str:
    """The same spans in DuckDB: places by running lengths, links by plain interval joins."""
    parts = []
    for number, (name, pattern, group, least) in enumerate(credentials.KINDS):
        quoted = pattern.replace("'", "''")
        extra = " AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')"
        parts.append(f"""
  SELECT rid, {number} AS kind, start, start + length(hit) AS stop FROM (
    SELECT rid, hit, value, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT rid, unnest(string_split_regex(t, '{quoted}')) AS gap, unnest(regexp_extract_all(t, '{quoted}', 0)) AS hit,
                 unnest(regexp_extract_all(t, '{quoted}', {group})) AS value,
                 unnest(range(len(string_split_regex(t, '{quoted}')))) AS i FROM d)
    WINDOW w AS (PARTITION BY rid ORDER BY i))
  WHERE hit IS NOT NULL AND length(value) >= {least}{extra if pattern == credentials.RANDOM else ""}""")
    reach = credentials.SCOPE
    scope = f"x.rid = p.rid AND (x.block = p.block OR (x.start < p.stop + {reach} AND p.start < x.stop + {reach}))"
    empty = credentials.EMPTY_LINE
    names = ", ".join(f"'{k[0]}'" for k in credentials.KINDS)
    joined = "coalesce(string_agg(([{0}])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')".format(names)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
parts AS (SELECT rid, kind, f.start::BIGINT AS start, f.stop::BIGINT AS stop,
                 len(regexp_extract_all(substr(t, 1, f.start::BIGINT), '{empty}')) AS block FROM found f JOIN d USING (rid)),
base AS (SELECT * FROM parts WHERE kind < 3),
weak AS (SELECT * FROM parts p WHERE kind >= 3
         AND NOT EXISTS (SELECT 1 FROM base x WHERE x.rid = p.rid AND x.start <= p.start AND p.stop <= x.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
shown AS (SELECT * FROM base UNION ALL SELECT * FROM weak p WHERE
  (kind = 4 OR EXISTS (SELECT 1 FROM every x WHERE x.kind IN (0, 2, 4) AND {scope}))
  AND (kind = 3 OR EXISTS (SELECT 1 FROM every x WHERE x.kind IN (1, 3) AND {scope}))),
b AS (SELECT rid, sha256({joined}) AS base_sha256, count(*) FILTER (kind = 0) AS n_assign,
             count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex FROM base GROUP BY rid),
s AS (SELECT rid, {joined} AS spans FROM shown GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN s USING (rid)
"""


@query(secret_sql())
def op10_secret_scan(spark, sf):
    """Secrets in every whole text of the documents, with linked weak candidates."""
    return credentials.secret_report(table(spark, sf, "documents"))


@query()
def op9_token_counts(spark, sf):
    """Unigram token counts of every whole text."""
    return tokencount.token_counts(table(spark, sf, "documents"), tokencount.read_vocabulary(TOKENIZER))


# Fixed value: the conversation of control strings that op3 adds.
HARD_TEXT = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query(CHAT_SQL)
def op3_chat_format(spark, sf):
    """All conversations and one of control strings, packed as a prefix tree and read back."""
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    ranks = chat.read_ranks(TURN_RANKS)
    stream = chat.packed(talks, ranks)
    written = chat.Packed(checkpoint(stream.nodes), stream.paths, stream.members)
    return chat.read_back(written, ranks)


@query()
def op6_toxicity(spark, sf):
    """Toxicity of every whole text, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op1_language_id(spark, sf):
    """Languages of all documents and all pages, from text, markup, address and host."""
    documents, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    nobody = F.lit(None).cast("long")
    rows = language.document_rows(documents, F.col("doc_id").cast("long").alias("doc_id"), nobody.alias("page_id"))
    marked = pages.select(nobody.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.unionByName(language.page_rows(marked, "doc_id", "page_id"))
    found = language.identify(rows, language.fit(documents))
    return found.select("doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "accepted")


VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
fine AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON counted.a = vec_id LEFT JOIN roots ON roots.a = vec_id
"""


@query(VECTOR_SQL)
def op2_near_vectors(spark, sf):
    """Links of all embeddings of equal label at a cosine of 0.93."""
    return covertree.near_vectors(table(spark, sf, "embeddings"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
said AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM windows),
firsts AS (SELECT s, min(doc_id) AS first FROM said GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM said JOIN firsts USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS said, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query(SUBSTRING_SQL)
def op8_substring_dedup(spark, sf):
    """Words of all documents that no 13-word window of an earlier document covers."""
    found = substrings.without_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


RESAMPLE_SQL = r"""
WITH said AS (
  SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
cut AS (SELECT side, rid, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM said),
words AS (SELECT side, rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM cut),
-- A checksum takes a byte in eight steps of one bit: the byte comes with the first of them.
bits AS (SELECT word, flatten(list_transform(range(octet_length(encode(word))),
                  lambda k: [('0x' || substr(hex(encode(word)), (2 * k + 1)::INT, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b
         FROM (SELECT DISTINCT word FROM words)),
follow AS (SELECT side, rid, i, b, lead(b) OVER w AS b2, lead(b, 2) OVER w AS b3
           FROM words JOIN bits USING (word) WINDOW w AS (PARTITION BY side, rid ORDER BY i)),
one AS (SELECT *, list_reduce(b, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT) AS c1 FROM follow),
two AS (SELECT *, CASE WHEN b2 IS NOT NULL THEN list_reduce([32, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] || b2,
                    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), c1) END AS c2 FROM one),
three AS (SELECT *, CASE WHEN b3 IS NOT NULL THEN list_reduce([32, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] || b3,
                    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), c2) END AS c3 FROM two),
runs AS (SELECT side, rid, xor(unnest([c1, c2, c3]), 4294967295) % 10000 AS bucket FROM three),
per AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM runs WHERE bucket IS NOT NULL GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM per),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS g FROM per, total),
weighed AS (SELECT rid, count(*) AS n, sum(g)::BIGINT AS weight FROM runs JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE))))::BIGINT AS score
  FROM cut LEFT JOIN weighed USING (rid) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
         5 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""


@query(RESAMPLE_SQL)
def op11_importance_resample(spark, sf):
    """All documents weighed against the benchmark's texts; five in a hundred are drawn."""
    return resampling.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op13_token_alignment(spark, sf):
    """Every whole text through two tokenizers, their groups, links and corpus-wide link counts."""
    return alignment.aligned(table(spark, sf, "documents"), ALIGNED)


@query()
def op12_url_filter(spark, sf):
    """Every page's URL by rule, or by boosted trees that learn from the URLs the rules judge."""
    return urlfilter.judge(table(spark, sf, "pages"), URL_RULES)
