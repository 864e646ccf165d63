"""Queries over texts, pages and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import reads
from ..sources.tables import table
from .registry import query


@query("""
WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS k FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS first, count(*) OVER (PARTITION BY k) AS copies FROM k)
SELECT doc_id, first, copies FROM m WHERE copies > 1
""")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.plain_key(F.col("text")), 256).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return keyed.join(groups, "key").select("doc_id", "first", "copies")


@query()
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.folded("text").alias("folded"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.readable("html", "url").alias("text"))


@query("""
SELECT page_id, regexp_replace('open ' || regexp_replace(url, '^https?:/', '') || ' on 2024/01/02', '(^|[\\s"''(=])(?:~|/[^\\s/"''()]+)(?:/[^\\s/"''()]+)*/([^\\s/"''()]+)', '\\1\\2', 'g') AS scrubbed FROM pages
""")
def path_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("open "), F.regexp_replace("url", "^https?:/", ""), F.lit(" on 2024/01/02"))
    return table(spark, sf_dir, "pages").select("page_id", tx.scrub_paths(line).alias("scrubbed"))


@query("""
WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), p AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 5], ' ') AS piece FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b)),
d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 5], ' ') AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d)),
h AS (SELECT item_id, doc_id, count(*) AS n FROM p JOIN g USING (piece) GROUP BY 1, 2), s AS (SELECT item_id, count(*) AS pieces FROM p GROUP BY 1)
SELECT item_id, count(*) AS documents, CAST(sum(CASE WHEN n = pieces THEN 1 ELSE 0 END) AS BIGINT) AS wholly FROM h JOIN s USING (item_id) GROUP BY item_id
""")
def fragment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.reads import fragment_hits as hits

    return hits(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 6)


@query("""
WITH w AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS jaccard
FROM w a JOIN w b ON b.item_id = a.item_id + 1
""")
def jaccard_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    other = sets.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("t").alias("u"))
    both = sets.join(other, "item_id")
    return both.select(F.col("item_id").alias("a"), "b", F.round(reads.set_share(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query()
def best_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a brand's parts of one size as reads of one name."""
    return reads.best_read(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "p_name").withColumn("score", F.round("score", 4))


@query()
def best_word_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents in one language that begin with the same eight letters, as reads of one word."""
    words = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", r"\s+")).alias("n", "read")).filter("length(read) >= 8")
    seen = words.withColumns({"head": F.lower(F.left("read", F.lit(8))), "at": F.struct("doc_id", "n")})
    return reads.best_read(seen, ["lang", "head"], "at", "read").withColumn("score", F.round("score", 4))


@query("""
WITH l AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i, text FROM benchmark),
t AS (SELECT item_id, text || ' il' AS b, array_to_string(string_split(text, ' ')[1:CAST(i AS INTEGER)], ' ') || CASE i % 3 WHEN 0 THEN 'l' WHEN 1 THEN ' |' ELSE '' END AS read FROM l),
c AS (SELECT item_id, b, lower(regexp_replace(b, '\\s+', '', 'g')) AS f, lower(regexp_replace(read, '\\s+', '', 'g')) AS c FROM t),
r AS (SELECT item_id, b, count(DISTINCT CASE WHEN length(c) >= 2 AND contains('|li1!', right(c, 1)) AND length(c) < length(f) AND starts_with(left(f, length(f) - 1), left(c, length(c) - 1)) AND NOT starts_with(f, c) THEN c END) AS carets FROM c GROUP BY 1, 2)
SELECT item_id, carets, CASE WHEN carets >= 2 THEN rtrim(left(b, length(b) - 1)) ELSE b END AS line FROM r
""")
def caret_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are typed, word by word, some with a caret at their end."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.posexplode(F.split("text", " ")).alias("i", "word"))
    mark = F.when((F.col("i") + 1) % 3 == 0, "l").when((F.col("i") + 1) % 3 == 1, " |").otherwise("")
    rows = items.select("item_id", F.concat("text", F.lit(" il")).alias("full"), F.concat(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("i") + 1), " "), mark).alias("read"))
    return reads.caret_dropped(rows, ["item_id"], "read", "full").select("item_id", "carets", F.col("full").alias("line"))


@query("""
WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
r AS (SELECT doc_id, w, CASE doc_id % 4 WHEN 0 THEN array_to_string(w[1:3], ' ') WHEN 1 THEN upper(array_to_string(w[1:3], '  ')) WHEN 2 THEN array_to_string(w[1:3], '') ELSE left(array_to_string(w[1:3], ' '), length(array_to_string(w[1:3], ' ')) - 1) END AS read FROM t),
c AS (SELECT doc_id, w, replace(lower(replace(read, ' ', '')), 'ß', 'ss') AS c, replace(lower(array_to_string(w, '')), 'ß', 'ss') AS f FROM r)
SELECT doc_id, length(f) - length(c) >= 2 AND len(list_filter(range(1, least(len(w), length(c) + 1)), lambda k: replace(lower(array_to_string(w[1:k], '')), 'ß', 'ss') = c)) > 0 AS is_prefix FROM c
""")
def word_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three words of documents as they are, in capitals, run together, and cut inside of the third."""
    words = F.split(F.trim(tx.collapse(F.col("text"))), " ")
    first = F.array_join(F.slice(words, 1, 3), " ")
    read = F.when(F.col("doc_id") % 4 == 0, first).when(F.col("doc_id") % 4 == 1, F.upper(F.array_join(F.slice(words, 1, 3), "  "))).when(F.col("doc_id") % 4 == 2, F.array_join(F.slice(words, 1, 3), "")).otherwise(F.left(first, F.length(first) - 1))
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_prefix(read, F.col("text")).alias("is_prefix"))


@query("""
WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 200)) AS start FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(start AS INTEGER) AS start, substr(text, start + 1, 200) AS slice, CASE WHEN length(text) > start + 200 THEN CAST(start + 200 AS INTEGER) END AS next_start FROM p
""")
def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.pages(table(spark, sf_dir, "documents"), "doc_id", "text", 200)


@query("""
WITH t AS (SELECT source, lang, string_split(text, chr(10))[1] AS r, doc_id, n_chars FROM documents), c AS (SELECT source, lang, r, count(*) AS n, min(doc_id) AS seen FROM t GROUP BY 1, 2, 3),
m AS (SELECT source, lang, arg_max(r, (n, -seen)) AS mode, CAST(max(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1, 2),
k AS (SELECT source, lang, avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.5 END) AS confidence FROM t GROUP BY 1, 2)
SELECT source, lang, mode, n, rows, rows >= 3 AND (length(regexp_replace(mode, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 OR (length(regexp_replace(mode, '[^\\p{L}\\p{N}]', '', 'g')) = 1 AND confidence >= 0.9)) AS kept
FROM m JOIN k USING (source, lang)
""")
def kept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import kept_texts as kept

    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.substring_index("text", "\n", 1).alias("r"), F.when(F.col("n_chars") > 500, 1.0).otherwise(0.5).alias("sure"))
    return kept(rows, ["source", "lang"], "r", "doc_id", "sure").select("source", "lang", "mode", "n", "rows", "kept")


@query("""
WITH t AS (SELECT doc_id, source, left(text, 4 + CAST(doc_id % 5 AS INTEGER)) AS text, doc_id AS first FROM documents)
SELECT source, count(*) AS tracks, min(first) AS first FROM t WHERE contains(lower(source || ' ' || doc_id), 'c1') GROUP BY source
""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.contains(F.lower(F.concat_ws(" ", "source", F.col("doc_id").cast("string"))), F.lit("c1")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("tracks"), F.min("doc_id").alias("first"))


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, text, unnest(range(1, 5)) AS step FROM conversations WHERE text IS NOT NULL),
r AS (SELECT conv_id, conv_id * 1000000 + turn * 10 + step AS id, lower(regexp_replace(left(text, (length(text) * step + 3) // 4), '\\s+', '', 'g')) AS c, turn * 100 + step * 5 AS a FROM t),
l AS (SELECT x.id AS p, y.id AS q FROM r x JOIN r y ON y.conv_id = x.conv_id AND y.a - x.a - 3 BETWEEN 0 AND 3 AND length(y.c) > length(x.c) AND length(x.c) > 0 AND starts_with(y.c, x.c)),
e AS (SELECT p, q FROM l UNION SELECT q, p FROM l), g(node, reach) AS (SELECT DISTINCT p, p FROM e UNION SELECT g.node, e.q FROM g JOIN e ON e.p = g.reach)
SELECT node, min(reach) AS component FROM g GROUP BY node
""")
def reveal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tracks import reveals

    # a typed line: the first characters of a turn, more of them at each step
    step = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step")
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text", step)
    ident = F.col("conv_id") * 1000000 + F.col("turn") * 10 + F.col("step")
    rows = turns.select("conv_id", ident.alias("id"), F.substring("text", F.lit(1), F.floor((F.length("text") * F.col("step") + 3) / 4).cast("int")).alias("text"), (F.col("turn") * 100 + F.col("step") * 5).alias("first"))
    return reveals(rows.withColumn("last", F.col("first") + 3), ["conv_id"], "id", "text", gap=3)


@query("""
SELECT doc_id, CASE WHEN label IN ('en', 'de', 'fr', 'es') THEN label END AS label, left(note, 120) AS note
FROM (SELECT doc_id, json_extract_string(j, '$.label') AS label, json_extract_string(j, '$.note') AS note
      FROM (SELECT doc_id, regexp_extract('Sure: {"label": "' || lang || '", "note": "' || source || '"} done', '\\{.*\\}') AS j FROM documents))
""")
def captions_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit('Sure: {"label": "'), "lang", F.lit('", "note": "'), "source", F.lit('"} done'))
    label, note = reads.parsed_answer(answer, "label", ["en", "de", "fr", "es"], "note", 120)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), note.alias("note"))


@query("""SELECT event_id, '{"k": ' || CAST(props->>'$.k' AS INTEGER) || ', "in": [{"n": 1}]}' AS props FROM events""")
def redacted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"k": '), k, F.lit(', "apiToken": "x", "in": [{"n": 1, "user_secret": 2}]}'))
    return table(spark, sf_dir, "events").select("event_id", tx.redacted("token|secret|password")(nested).alias("props"))
