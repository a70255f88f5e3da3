"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probatio.llm import (
    ann, bagminhash, bpe, cascade, chat, exact, langid, mixing, search, sharding, templates, trie,
    viterbi,
)
from probatio.llm.common import table

WEIGHT_CYCLE = (5, 2, 1)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150% of all words, shared 5:2:1 along the sources, at most two passes over each."""
    pieces = mixing.mix(table(spark, sf_dir, "documents"), WEIGHT_CYCLE, share=1.5, most=2)
    return mixing.taken(pieces).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size, w,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
targets AS (
  SELECT source, source_size,
    least(2.0::DOUBLE * source_size, (SELECT max(level) FROM levels) * w) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS quota,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source
      ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  greatest(0, least(p + size, quota) - p)
    + greatest(0, least(source_size + p + size, quota) - source_size - p) AS taken
FROM placed
"""


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.where(~langid.held_out() & F.col("lang").isNotNull())
    return langid.identify(docs, labelled).select(
        "doc_id", langid.held_out().alias("held_out"), "found.lang_pred", "found.score",
        "found.coverage")


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are equal in two documents or whose template recurs."""
    kept = templates.drop_recurring_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_TEMPLATE_SQL = f"""
WITH docs AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM docs),
masked AS (
  SELECT doc_id, place, list_filter(string_split_regex(
    regexp_replace(line, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM lines),
leafed AS (
  SELECT doc_id, place, w, [CAST(len(w) AS VARCHAR)] || w[1:{templates.DEPTH}] AS leaf
  FROM masked WHERE len(w) >= {templates.MIN_WORDS}),
found AS (
  SELECT * FROM leafed WHERE leaf IN (
    SELECT leaf FROM leafed GROUP BY leaf
    HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCUMENTS})),
tokens AS (
  SELECT doc_id, place, leaf, unnest(range(1, len(w) + 1)) AS spot, unnest(w) AS word FROM found),
shaped AS (
  SELECT doc_id, place, leaf, list(CASE WHEN n >= {templates.MIN_DOCUMENTS} AND word <> '<*>'
      THEN word ELSE '<*>' END ORDER BY spot) AS template,
    count(*) FILTER (n >= {templates.MIN_DOCUMENTS} AND word <> '<*>') / count(*) AS solid
  FROM (SELECT *, count(*) OVER (PARTITION BY leaf, spot, word) AS n FROM tokens)
  GROUP BY doc_id, place, leaf),
recurring AS (
  SELECT leaf, template, min(doc_id) AS first_id FROM shaped
  WHERE solid >= {templates.CONSTANT} GROUP BY leaf, template
  HAVING count(DISTINCT doc_id) >= {templates.MIN_DOCUMENTS}),
dropped AS (
  SELECT doc_id, list(place) AS places
  FROM shaped JOIN recurring USING (leaf, template)
  WHERE doc_id <> first_id GROUP BY doc_id)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(places), 0) AS n_dropped,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN lines ELSE list_filter(lines,
    lambda x, i: NOT list_contains(places, i)) END, chr(10)), '')) AS kept_sha256
FROM docs LEFT JOIN dropped USING (doc_id)
"""


#: Equal lines beside those of templates.
OP3_SQL = _TEMPLATE_SQL.replace("""dropped AS (
  SELECT doc_id, list(place) AS places
  FROM shaped JOIN recurring USING (leaf, template)
  WHERE doc_id <> first_id GROUP BY doc_id)""", """worded AS (
  SELECT doc_id, place, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM lines),
equal AS (
  SELECT doc_id, place, doc_id > min(doc_id) OVER (PARTITION BY w) AS later
  FROM worded WHERE len(w) > 0),
dropped AS (
  SELECT doc_id, list(place) AS places FROM (
    SELECT doc_id, place FROM shaped JOIN recurring USING (leaf, template)
    WHERE doc_id <> first_id
    UNION SELECT doc_id, place FROM equal WHERE later) GROUP BY doc_id)""")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    base = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = cascade.judge(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           first=cascade.Rule("base", base))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", base.alias("base_failed"), "kept")


OP4_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
      lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i:i + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows),
covered AS (
  SELECT doc_id, count(*) AS c FROM (
    SELECT DISTINCT doc_id, i + k AS p
    FROM twice, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1)
  GROUP BY doc_id),
counted AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(c, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS lettered,
    len(list_filter(string_split(text, chr(10)),
      lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS bullets,
    len(list_filter(string_split(text, chr(10)),
      lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS ellipses
  FROM words LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines
    OR 10 * lettered < 8 * n_words OR 2 * n_dup_lines > n_lines
    OR 10 * n_symbols > n_words
    OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM judged
"""


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 byte_bpe_path())
    return coded.select("doc_id", *bpe.token_digests(F.col("coded")))


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of documents, without regard to the case of A-Z."""
    return exact.deduplicate(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share a shard."""
    packed = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of a vocabulary file."""
    import public_tokenizers

    counted = viterbi.count_tokens(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "counted.n_tokens", "counted.score")


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: weighted Jaccard of word shingles of 0.8 or more."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
bags AS (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5
      THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words)
  GROUP BY doc_id, s),
totals AS (SELECT doc_id, sum(c) AS t FROM bags GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS i
  FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT x, y FROM common JOIN totals p ON p.doc_id = x JOIN totals q ON q.doc_id = y
  WHERE i >= 0.8 * (p.t + q.t - i)),
linked AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN linked l ON l.x = r.y),
named AS (SELECT x AS doc_id, max(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size,
  doc_id = class_id AS kept
FROM named
"""


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one of control strings, rendered and read back.

    Each row is an event that starts a message; rows of one turn stay apart.
    """
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text").unionByName(planted)
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    events = rows.select(
        "conv_id", F.struct("turn", F.row_number().over(same_turn).alias("n"))
        .alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"),
        "role", "text")
    rendered = chat.format_conversations(events)
    turns = chat.read_turns(F.col("formatted"))
    read = rendered.select("conv_id", "formatted", turns.alias("turns"), chat.read_loss(
        F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text)
    + length(regexp_replace(role, '[^~<[\\n]', '', 'g'))
    + length(regexp_replace(text, '[^~<[]', '', 'g'))
    + CASE WHEN role = 'assistant' THEN 9 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                       F.col("vec_id") % 100 == 0, k=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return trie.conversation_trie(table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text"))


#: CRC-32 bit by bit: after each byte, eight marks (-1) for a step of the register.
OP12_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
coded AS (
  SELECT conv_id, turn, text, sha256(length(role) || ':' || role || text) AS id FROM turns),
own AS (
  SELECT conv_id, list({'id': id, 'bytes': strlen(text)}
    ORDER BY turn NULLS FIRST, id) AS path FROM coded GROUP BY conv_id),
hashed AS (
  SELECT conv_id, path, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c:
      [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x:
    CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM own),
paths AS (
  SELECT c.conv_id, list_concat(coalesce(b.path[1:c.h], []), c.path[c.h + 1:]) AS path
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (
  SELECT conv_id, d, list_transform(path[1:d], lambda t: t.id) AS p, len(path) AS n,
    CASE WHEN d > 0 THEN path[d].bytes ELSE 0 END AS bytes
  FROM paths, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(bytes) AS own_saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, p)),
below AS (
  SELECT up AS d, p[1:up] AS p, sum(own_saved) AS saved, count_if(n_children = 0) AS leaves
  FROM counted, LATERAL (SELECT unnest(range(0, d + 1)) AS up) GROUP BY ALL)
SELECT counted.conv_id, counted.d AS depth, parents.conv_id AS parent_conv_id, counted.n_convs,
  n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  counted.ends_sha256
FROM counted JOIN below USING (d, p)
LEFT JOIN nodes parents ON parents.d = counted.d - 1 AND parents.p = counted.p[1:counted.d - 1]
"""


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search.rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    '{search.UPPER}', '{search.LOWER}'), '{search.TERM}') AS w
  FROM documents),
sized AS (SELECT r, doc_id, len(w) AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{search.UPPER}',
      '{search.LOWER}'), '{search.TERM}')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN held USING (term) JOIN sized USING (r), totals
  GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0)
WHERE rank <= 10
"""


def registry() -> dict:
    """name -> (query, SQL twin or None)"""
    return {
        "op1_source_mix": (op1_source_mix, OP1_SQL),
        "op2_language_filters": (op2_language_filters, None),
        "op3_line_templates": (op3_line_templates, OP3_SQL),
        "op4_quality_cascade": (op4_quality_cascade, OP4_SQL),
        "op5_bpe_lexicon": (op5_bpe_lexicon, None),
        "op6_block_naming": (op6_block_naming, OP6_SQL),
        "op7_shards": (op7_shards, None),
        "op8_token_counts": (op8_token_counts, None),
        "op9_bagminhash": (op9_bagminhash, OP9_SQL),
        "op10_chat_format": (op10_chat_format, OP10_SQL),
        "op11_collision_search": (op11_collision_search, None),
        "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
        "op13_term_pipeline": (op13_term_pipeline, OP13_SQL),
    }
