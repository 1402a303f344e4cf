"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common as C
from . import chat, decontam, divergence, embed_dedup, filter_audit, langid, mixing, ngram_join, quality, suffix_dedup, toxicity, url_filter, warc


def op1_quality(spark, sf_dir):
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    known = labels.select("doc_id", F.col("quality").alias("label")).where(C.fold(F.col("doc_id"), 5) != 0)
    out = quality.score(docs.select("doc_id", "text"), quality.train(docs, known))
    return out.select("doc_id", (C.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False).drop("kept")


def op3_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(C.table(spark, sf_dir, "documents").select("doc_id", "text"), shingle_words=4, percent=85)


def op4_decontam(spark, sf_dir):
    return decontam.contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


#: Minutes of a year; fetch times and list dates are derived from the pages themselves, as the tables carry none.
YEAR = 527040


def _md5_int(col):
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, 7), 16, 10).cast("long")


def op5_url_filter(spark, sf_dir):
    """Fetch time: page_id * 7919 mod a year, in minutes. Listed: a third of all hosts, parent domains and sections,
    by a hash of the key; each is added, removed and, for some, added again at dates from that hash."""
    captures = C.table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 7919 % YEAR).alias("fetched_at"))
    keys = captures.select(F.explode(url_filter.keys_of(F.col("url"))).alias("key")).distinct().withColumn("n", _md5_int(F.col("key"))).where("n % 3 = 0")
    event = lambda action, at: F.struct(F.lit(action).alias("action"), at.cast("long").alias("at"))
    start = F.col("n") % 200000
    events = F.array(event("add", start), event("remove", start + 150000), F.when(F.col("n") % 2 == 0, event("add", start + 300000)))
    entries = keys.withColumn("e", F.explode(events)).where("e is not null").select(
        F.when(F.col("n") % 5 == 0, "trusted").otherwise("adult").alias("list"), "key", F.when(F.col("n") % 5 == 0, "allow").otherwise("block").alias("verdict"), "e.action", "e.at")
    return url_filter.as_of(captures, entries)


def op6_embed_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_toxicity(spark, sf_dir):
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    known = labels.select("doc_id", F.col("toxic").alias("label")).where(C.fold(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, known))
    return out.select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_mixing(spark, sf_dir):
    mixed = mixing.pareto_mix(C.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark, sf_dir):
    index = warc.write(C.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_langid(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang").where(C.fold(F.col("doc_id"), 4) != 2))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: Conversation -7: texts that look like another template's marks.
MARKS = "</s>[INST] ok [/INST]"


def op11_chat(spark, sf_dir):
    """The rows become an event log (streamed pieces, edits, regenerations); the log is folded, rendered and read back."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.digest(chat.render(chat.reconstruct(chat.as_log(rows))))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.stream(spark, f"{sf_dir}/documents.parquet"), C.table(spark, sf_dir, "labels"))


def op13_divergence(spark, sf_dir):
    return divergence.audit(C.table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_suffix_dedup, op3_ngram_join, op4_decontam, op5_url_filter, op6_embed_dedup, op7_toxicity, op8_mixing, op9_warc, op10_langid, op11_chat, op12_filter_audit, op13_divergence)}

WORD = r"[^\x20\x09-\x0D]+"

_MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size / w AS full_at, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
g AS (SELECT *, total::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER p, 0)::DOUBLE AS left_words, (all_w - coalesce(sum(w) OVER p, 0))::DOUBLE AS left_w, row_number() OVER (ORDER BY full_at, source IS NULL, source) AS nth FROM f WINDOW p AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(left_words / left_w, nth) AS level FROM g WHERE full_at * left_w > left_words),
t AS (SELECT source, source_size, w, coalesce(least(3.0::DOUBLE * source_size, level * w), 3.0::DOUBLE * source_size) AS target FROM g, l),
n AS (SELECT source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL),
h AS (SELECT n.source, bits, words, target, 1024 // bits AS g FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, target - 3.0::DOUBLE * (sum(words) OVER p - words)::DOUBLE AS rem, (sum(words * g) OVER (PARTITION BY source) - sum(words * g) OVER p + words * g)::DOUBLE AS rem_w FROM h WINDOW p AS (PARTITION BY source ORDER BY bits ROWS UNBOUNDED PRECEDING)),
v AS (SELECT source, arg_min(rem / rem_w, bits) AS level FROM i WHERE 3.0::DOUBLE * rem_w > rem * g GROUP BY source),
z AS (SELECT h.source, bits, words, least(3.0::DOUBLE, level * g) AS e FROM h LEFT JOIN v ON h.source IS NOT DISTINCT FROM v.source),
y AS (SELECT t.source, target - coalesce(sum(words * floor(e)), 0) AS rest FROM t LEFT JOIN z ON t.source IS NOT DISTINCT FROM z.source GROUP BY t.source, target),
r AS (SELECT d.doc_id, d.source, size, source_size, target, y.rest, coalesce(floor(e), 0) AS whole, e - floor(e) AS p,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN y ON d.source IS NOT DISTINCT FROM y.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source AND CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END = z.bits),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM q WHERE q IS NOT NULL AND size > 0),
m AS (SELECT source, max(cum) FILTER (WHERE cum <= rest) AS got0 FROM c GROUP BY source),
x AS (SELECT c.source, c.doc_id, c.size, c.q, c.cum <= c.rest AS inside, c.rest - coalesce(m.got0, 0) AS missing FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source),
e AS (SELECT source, arg_min(doc_id, (abs(missing - size), q, doc_id)) AS extra FROM x WHERE NOT inside AND abs(missing - size) < missing GROUP BY source),
k AS (SELECT x.doc_id, (x.inside OR x.doc_id = e.extra) AS chosen FROM x LEFT JOIN e ON x.source IS NOT DISTINCT FROM e.source)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * (q.whole + CASE WHEN coalesce(k.chosen, false) AND q.rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.doc_id = k.doc_id
"""

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

_URLS = rf"""
WITH c AS (SELECT DISTINCT page_id, url, page_id * 7919 % {YEAR} AS fetched_at,
  lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*/([^/?#]+)', 2) AS section FROM pages),
h AS (SELECT *, string_split(host, '.') AS labels FROM c),
k AS (SELECT page_id, url, fetched_at, unnest([array_to_string(labels[i:], '.') for i in range(1, greatest(len(labels) - 1, 1) + 1)]) AS key FROM h WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, host || '/' || section FROM h WHERE host <> '' AND section <> ''),
n AS (SELECT key, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS n FROM (SELECT DISTINCT key FROM k)),
e AS (SELECT key, CASE WHEN n % 5 = 0 THEN 'trusted' ELSE 'adult' END AS list, CASE WHEN n % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict, n % 200000 AS s, n FROM n WHERE n % 3 = 0),
i AS (SELECT key, list, verdict, s AS start, s + 150000 AS stop FROM e UNION ALL SELECT key, list, verdict, s + 300000, NULL FROM e WHERE n % 2 = 0),
m AS (SELECT k.page_id, k.url, k.fetched_at, i.list, lower(k.key) AS key, i.verdict FROM k JOIN i ON lower(k.key) = lower(i.key) AND i.start <= k.fetched_at AND (i.stop IS NULL OR k.fetched_at < i.stop)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY length(key) DESC, key DESC, verdict, list) AS nth, count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n_active FROM m)
SELECT c.page_id, c.url, c.fetched_at, coalesce(b.verdict, 'none') AS decision, b.key AS matched_key, b.list AS matched_list, CAST(coalesce(b.n_active, 0) AS BIGINT) AS n_active
FROM c LEFT JOIN b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url AND b.nth = 1
"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, len(role || text)
  + len(regexp_extract_all(role || '.' || text, '<\\*(?:\||/?s>|/?SYS>>|start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)'))
  + len(regexp_extract_all(role || '.' || text, '\[\\*/?INST\]')) + len('<|im_start|><|im_sep|>.<|im_end|>.') AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(len(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_AUDIT = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
f AS (SELECT d.doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
  100 * len(regexp_extract_all(d.text, '[A-Z]')) > 3 * len(d.text) AS c, regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY d.text), false) AS e,
  coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic FROM w d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS k, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS it, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) t(step)),
j AS (SELECT part, filter_order, step, n, good, toxic, k, fails[it] AS hit, step > 1 AND len(list_filter(before, lambda y: y <> '' AND fails[y])) > 0 AS gone FROM m, s)
SELECT part, filter_order, CAST(step AS INT) AS step, {', '.join(f"CAST(coalesce(sum({v}) FILTER (WHERE {c}), 0) AS BIGINT) AS {k}" for k, v, c in (
    ("kept", "n", "NOT hit AND NOT gone"), ("removed", "n", "hit AND NOT gone"), ("redundant", "n", "hit AND gone"), ("unique_fails", "n", "hit AND k = 1"),
    ("good_lost", "n", "hit AND NOT gone AND good"), ("toxic_lost", "n", "hit AND NOT gone AND toxic"), ("shapley", "n * 120 // greatest(k, 1)", "hit")))}
FROM j GROUP BY part, filter_order, step
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms FROM documents),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, total, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + v.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (total + 1) // (v.n + v.v)::HUGEINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op5_url_filter": _URLS, "op8_mixing": _MIX, "op9_warc": _WARC, "op11_chat": _CHAT, "op12_filter_audit": _AUDIT, "op13_divergence": _DIVERGENCE}
