"""The queries of the thirteen operators, each over its whole table, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taktwerk.llm import chat, langid, secrets, warc
from taktwerk.llm.bpe import bpe_encode
from taktwerk.llm.collocation import mine
from taktwerk.llm.common import fresh_folder, read, removed, written
from taktwerk.llm.decontaminate import decontaminate
from taktwerk.llm.divergence import audit
from taktwerk.llm.embeddings import near_vectors
from taktwerk.llm.html import extract_text
from taktwerk.llm.passages import repeated_passages
from taktwerk.llm.sharding import shard
from taktwerk.llm.simhash import simhash_components
from taktwerk.llm.units import repeated_units


def vocabulary_path() -> str:
    """Where the public word BPE vocabulary lies, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k,
         unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win
  FROM item WHERE len(w) > 0),
doc_window AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM words, (SELECT DISTINCT k FROM item_window) WHERE len(w) >= k),
hits AS (
  SELECT d.r, d.i, d.k, x.item_id FROM doc_window d JOIN item_window x
    ON x.k = d.k AND x.win = array_to_string(d.w[d.i:d.i + d.k - 1], ' ')),
hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = turns.unionByName(planted)
    out = chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    out = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("said"), chat.learned(F.col("formatted"), F.col("loss")).alias("loss"))
    turn = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>') AS et,
            replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS er FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || er || '>' || chr(10) || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(rows, ["doc_id", "held_out"], langid.fit_on_documents(docs))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), ["doc_id"], max_bytes=128 << 10)


OP6_SQL = """
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h,
         coalesce(strlen(text), 0) AS n_bytes FROM documents),
per_hash AS (SELECT h, sum(n_bytes) AS n_bytes FROM d GROUP BY h),
level AS (
  SELECT k AS depth, h >> (32 - k) AS prefix, sum(n_bytes) AS n, min(h) = max(h) AS alone
  FROM per_hash, range(0, 33) AS r(k) GROUP BY ALL),
leaf AS (
  SELECT h, min(k) AS depth FROM per_hash, range(0, 33) AS r(k) JOIN level ON level.depth = k AND level.prefix = h >> (32 - k)
  WHERE n <= 131072 OR alone OR k = 32 GROUP BY h)
SELECT doc_id, d.n_bytes::BIGINT AS n_bytes, depth::BIGINT AS shard_depth,
       CASE depth WHEN 0 THEN 'all' ELSE lpad(bin(d.h >> (32 - depth)), depth::INT, '0') END AS shard,
       level.n <= 131072 AS fits
FROM d JOIN leaf USING (h) JOIN level USING (depth) WHERE level.prefix = d.h >> (32 - depth)
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe_encode(read(spark, sf_dir, "documents"), ["doc_id"], vocabulary_path(), outputs=outputs)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secrets.scan(docs, ["doc_id"], secrets.fit(docs))

    def listed(spans: str):
        one = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
        return F.array_join(one, ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    learned = F.size(F.filter("spans", lambda x: x["kind"] == secrets.LEARNED)).cast("long").alias("n_grammar")
    digest = F.sha2(listed("base"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, secrets.KINDS), digest, listed("spans").alias("spans"), learned, "best_bits")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(read(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 51 words or more wherever lines break; op10_units, the same with lines as units, finds whole lines only."""
    return repeated_passages(read(spark, sf_dir, "documents")).drop("doc_key")


# White space, and letters that are words of their own.
WHITE = r"\x20\x09-\x0D\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ALONE = r"\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
OP10_PASSAGES_SQL = f"""
WITH token AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(text, '[{WHITE}]*(?:[{ALONE}]|[^{WHITE}{ALONE}]+)') AS t FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT row_number() OVER () AS r, doc_id, t, list_transform(t, lambda x: regexp_replace(x, '^[{WHITE}]+', '')) AS w FROM token WHERE len(t) > 50),
one AS (SELECT r, doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w, unnest(t) AS t FROM placed),
word AS (
  SELECT r, doc_id, i, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, length(w) AS n,
         sum(length(t)) OVER (PARTITION BY r ORDER BY i) AS e FROM one),
doc AS (SELECT r, doc_id, list(w ORDER BY i) AS w, list(e - n ORDER BY i) AS s, list(e ORDER BY i) AS e FROM word GROUP BY r, doc_id),
win AS (
  SELECT r, doc_id, unnest(range(0, len(w) - 50)) AS i,
         unnest(list_transform(range(1, len(w) - 49), lambda i: md5(array_to_string(w[i:i + 50], chr(10))))) AS h FROM doc),
ranked AS (
  SELECT *, first_value(r) OVER f AS kr, first_value(doc_id) OVER f AS kd, first_value(i) OVER f AS ki FROM win
  WINDOW f AS (PARTITION BY h ORDER BY doc_id NULLS LAST, r, i)),
again AS (
  SELECT *, kr = r AND ki + 51 > i AS over, CASE WHEN kr = r AND ki + 51 > i THEN ki + 51 ELSE i END AS since FROM ranked WHERE kr <> r OR ki <> i),
cut AS (
  SELECT *, CASE WHEN since > max(i + 51) OVER (PARTITION BY r ORDER BY since, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM again),
part AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY since, i) AS p FROM cut),
merged AS (
  SELECT r, p, min(since) AS unit_no, max(i) + 51 AS upto, min(CASE WHEN over THEN e[ki + 51] ELSE s[i + 1] END) AS start, max(e[i + 51]) AS "end",
         first(struct_pack(d := kd, k := since - i + ki) ORDER BY since, kd NULLS LAST, since - i + ki) AS kept
  FROM part JOIN (SELECT r, s, e FROM doc) USING (r) GROUP BY r, p)
SELECT doc_id, unit_no::INT AS unit_no, start::INT AS start, "end"::INT AS "end", (upto - unit_no)::INT AS n_words, kept.d AS kept_doc_id, kept.k::INT AS kept_unit_no
FROM merged JOIN (SELECT r, doc_id FROM doc) USING (r)
"""


OP10_SQL = r"""
WITH part AS (
  SELECT DISTINCT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line, text
  FROM documents WHERE text IS NOT NULL),
placed AS (
  SELECT doc_id, k - 1 AS unit_no, line,
         sum(length(line) + 1) OVER (PARTITION BY doc_id, text ORDER BY k) - length(line) - 1 AS start,
         regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+') AS w
  FROM part),
unit AS (SELECT *, array_to_string(w, ' ') AS norm FROM placed WHERE len(w) >= 5),
ranked AS (
  SELECT *, first_value(doc_id) OVER f AS kept_doc_id, first_value(unit_no) OVER f AS kept_unit_no FROM unit
  WINDOW f AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, unit_no))
SELECT doc_id, unit_no::INT AS unit_no, start::INT AS start, (start + length(line))::INT AS "end", len(w)::INT AS n_words,
       kept_doc_id, kept_unit_no::INT AS kept_unit_no
FROM ranked WHERE doc_id IS DISTINCT FROM kept_doc_id OR unit_no <> kept_unit_no
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c
    ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
own AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p
  FROM cell JOIN vocabulary USING (lang)),
whole AS (
  SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cell GROUP BY ALL) JOIN vocabulary USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of every page, written, normalised and read back by their index; the archives go when all is read."""
    folder = fresh_folder(spark)
    warc.write_archives(read(spark, sf_dir, "pages"), f"{folder}/streams")
    found = warc.read_back(warc.normalise(spark, f"{folder}/streams", f"{folder}/members"), with_payload=False)
    page, refers_to = (F.col(c).cast("long").alias(c) for c in ("page_id", "refers_to"))
    out = written(found.select(page, "payload_bytes", "payload_digest", "record_type", refers_to))
    removed(spark, folder)
    return out


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN k USING (h)
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
run AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p FROM w, range(1, 5) AS r(k) WHERE len(w) >= k),
f AS (SELECT lang, p, len(p) AS size, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, p, size, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT c.lang, c.p, c.size, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
around AS (
  SELECT DISTINCT s.lang, s.p FROM best s JOIN f q ON q.lang = s.lang AND q.size > s.size AND 100 * q.f >= 80 * s.a
  WHERE contains(' ' || array_to_string(q.p, ' ') || ' ', ' ' || array_to_string(s.p, ' ') || ' ')),
kept AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best ANTI JOIN around USING (lang, p))
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) WHERE rank <= 2000
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_chat": op2_chat,
    "op3_embeddings": op3_embeddings,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_secrets": op8_secrets,
    "op9_html": op9_html,
    "op10_passages": op10_passages,
    "op10_units": op10_units,
    "op11_divergence": op11_divergence,
    "op12_warc": op12_warc,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op3_embeddings": OP3_SQL,
    "op6_sharding": OP6_SQL,
    "op10_passages": OP10_PASSAGES_SQL,
    "op10_units": OP10_SQL,
    "op11_divergence": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
