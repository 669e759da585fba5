"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html, licenses, mixing, neighbours, repair, sharding, simhash, tokens, topk, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = simhash.component_ids(docs)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", html.main_text_column(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(rows, topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, "vec_id", k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", "text", sharding.record_bytes(F.col("text")).alias("size"), sharding.text_crc(F.col("text")).alias("text_crc32"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    told_apart = sharding.with_copy(sized.drop("text"), order)
    keys = [F.col("doc_id"), F.col("text_crc32"), F.col("copy")]
    slot_map = sharding.build_map(told_apart, keys, F.col("size"), 24)
    numbered = sharding.number(told_apart, keys, slot_map, order)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    records = chat.records_of_rows(rows).withColumns({"prompt": F.lit(None).cast("string"), "response": F.lit(None).cast("string")})
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(None).cast(records.schema["messages"].dataType).alias("messages"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))
    turns = chat.canonical_turns(records.unionByName(extra), ["messages", "prompt", "response"])
    written = chat.format_turns(turns).select("conv_id", "layout", "formatted", "loss_spans")
    back, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    joined = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = written.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("hits.items")  # strings in code-point order
    return scanned.select("doc_id", "hits.n_words", "hits.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))



def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a tree, its documents lie in folders of 64 ids below folders of 4096."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    steps = [F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 4096).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))]
    files = docs.select("doc_id", "text", F.concat_ws("/", *steps).alias("path"))
    return licenses.scan_licenses(files, "text", "path")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = neighbours.nearest(rows, neighbours.usable(F.col("embedding")), F.col("id") % 100 == 0, "vec_id", k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score", "variant")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    damaged = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair.repair(damaged, present=F.col("present")).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT r, i, g.k, item_id FROM grams g JOIN win ON g.g = win.g AND g.k = win.k),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_html": op4_html,
    "op5_topk": op5_topk,
    "op6_sharding": op6_sharding,
    "op7_chat": op7_chat,
    "op8_decontamination": op8_decontamination,
    "op9_tokens": op9_tokens,
    "op10_licenses": op10_licenses,
    "op11_neighbours": op11_neighbours,
    "op12_divergence": op12_divergence,
    "op13_repair": op13_repair,
}

_OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""

_OP7_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?<SYS>>|unk>|pad>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') AS esc FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + length(role) + 1 + length(esc) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# Sources reach the water level by the closed form; documents are numbered in the order of half octave, salt and id.
_OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, 2 * length(bin(size)) + CASE WHEN size >= 2 THEN CAST(substr(bin(size), 2, 1) AS INTEGER) ELSE 0 END AS cls,
      coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 16, 0) AS salt FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS BIGINT)) AS w FROM c GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * max(level) OVER ()) AS target,
      CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN '?' ELSE '=' || source END || '#17'), 1, 8) AS BIGINT) / 4294967296.0 AS shift FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, salt, doc_id NULLS LAST) AS k FROM c),
m AS (SELECT r.*, t.source_size, t.target, shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS share FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(k * share + shift) - floor((k - 1) * share + shift)) * size AS BIGINT) AS taken,
       CAST(floor(k * share + shift) - floor((k - 1) * share + shift) AS BIGINT) AS copies FROM m
"""

_OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
x AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 1)) // (s.total + v.v) AS p FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 1)) // (v.total + v.v) AS p FROM k JOIN v ON v.lang = k.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.p) * (p.p - q.p) // q.p FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.p),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 200
"""

# The repair as a shortest path: layer by layer over the rows, up to two inserted rows before each, the least of each state.
_OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) t(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations),
dealt AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1]))) % 20 AS kind FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt),
ids AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS a
             FROM damaged d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
told AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
                regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut, lag(a) OVER (PARTITION BY c ORDER BY i) || a NOT IN ('su', 'ua', 'au') AS odd FROM numbered),
r AS (SELECT *, blank OR seen AS gone, CAST(NOT blank AND NOT seen AND cut AS BIGINT) AS late FROM told),
ins(q, z, price, letters, said) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
      (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
op(q, z, price, letter, initial, role) AS (VALUES (0, 0, 3, 'D', NULL, NULL), (1, 1, 3, 'D', NULL, NULL), (2, 2, 3, 'D', NULL, NULL), (3, 3, 3, 'D', NULL, NULL),
      (0, 2, 2, 'R', NULL, 'user'), (1, 2, 2, 'R', NULL, 'user'), (3, 2, 2, 'R', NULL, 'user'), (2, 3, 2, 'R', NULL, 'assistant'),
      (0, 1, 0, 'K', 's', NULL), (0, 2, 0, 'K', 'u', NULL), (1, 2, 0, 'K', 'u', NULL), (3, 2, 0, 'K', 'u', NULL), (2, 3, 0, 'K', 'a', NULL)),
s(c, i, q, best) AS (
    SELECT c, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'said': CAST([] AS VARCHAR[])} FROM ids
    UNION ALL
    SELECT s.c, r.i, op.z, min({'cost': s.best.cost + ins.price + op.price + CASE WHEN op.letter = 'D' THEN 0 ELSE r.late END, 'audit': s.best.audit || ins.letters || op.letter,
           'said': s.best.said || ins.said || CASE WHEN op.letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(op.role, r.role) || ':' || r.text] END})
    FROM s JOIN r ON r.c = s.c AND r.i = s.i + 1 JOIN ins ON ins.q = s.q JOIN op ON op.q = ins.z
    WHERE op.letter = 'D' OR (NOT r.gone AND (op.letter = 'R' OR op.initial = r.a)) GROUP BY s.c, r.i, op.z),
n AS (SELECT c, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, coalesce(count_if(blank), 0) AS blank, coalesce(count_if(seen AND NOT blank), 0) AS duplicate, coalesce(sum(late), 0) AS truncated, coalesce(count_if(odd), 0) AS illegal
      FROM ids LEFT JOIN r USING (c) GROUP BY c),
f AS (SELECT s.c, min({'cost': s.best.cost + ins.price, 'audit': s.best.audit || ins.letters, 'said': s.best.said || ins.said}) AS best
      FROM s JOIN n ON n.c = s.c AND n.n = s.i JOIN ins ON ins.q = s.q AND ins.z IN (0, 3) GROUP BY s.c)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, CAST(blank AS BIGINT) AS blank, CAST(duplicate AS BIGINT) AS duplicate, CAST(truncated AS BIGINT) AS truncated, CAST(illegal AS BIGINT) AS illegal,
       CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ids JOIN n USING (c) JOIN f USING (c)
"""

ORACLES: dict[str, str] = {
    "op13_repair": _OP13_SQL,
    "op12_divergence": _OP12_SQL,
    "op3_mixing": _OP3_SQL,
    "op7_chat": _OP7_SQL,
    "op5_topk": _OP5_SQL,
    "op8_decontamination": _OP8_SQL,
}
