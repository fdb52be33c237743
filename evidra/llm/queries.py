"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.bpe import default_path
from evidra.llm.byte_bpe import BpeParams, encode_texts
from evidra.llm.byte_bpe import default_path as ranks_path
from evidra.llm.chat import DEFAULT as CHAT
from evidra.llm.chat import format_chat, read_chat
from evidra.llm.chunk_dedup import repeated_passages
from evidra.llm.collocations import collocations
from evidra.llm.decontaminate import contamination
from evidra.llm.importance import resample
from evidra.llm.minhash import MinHashParams, near_duplicates
from evidra.llm.packing import PackParams, pack
from evidra.llm.pii import BASE_KINDS, KINDS, find_pii
from evidra.llm.quality import fit_quality, score_quality
from evidra.llm.scratch import stored
from evidra.llm.tiff import file_features, texts_to_tiff, tiff_pages
from evidra.llm.token_files import TokenFileParams, read_token_files, write_token_files
from evidra.llm.toxicity import fit_toxicity, score_toxicity
from evidra.session import table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir), MinHashParams(words=4))


ORACLES["op1_minhash"] = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM base
), sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM sets),
one AS (SELECT doc_id, n_shingles, unnest(s) AS g FROM sized),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
  HAVING 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))
), reach(x, y) AS (
  SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sized LEFT JOIN low ON doc_id = x
"""


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op4_decontaminate"] = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i+9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), occ AS (SELECT doc_id, item_id, i, size FROM spots JOIN win USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_token_files(texts(spark, sf_dir), TokenFileParams(default_path(), end_id=2))
    return read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(texts(spark, sf_dir), PackParams(default_path(), end_id=1, capacity=2048))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = texts_to_tiff(texts(spark, sf_dir), mixed=True)
    media = media.withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return file_features(tiff_pages(media))


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    fixed = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = read_chat(stored(format_chat(conversations.unionByName(fixed)), "chat"))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _escaped(text: str) -> str:
    """SQL that escapes like the default chat template."""
    sql = f"replace({text}, '\\', '\\\\')"
    for mark in CHAT.control:
        sql = f"replace({sql}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return sql


ORACLES["op5_chat"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length({_escaped("text")}) + CASE role {" ".join(f"WHEN '{k}' THEN {len(r.before) + len(r.after)}" for k, r in CHAT.roles.items())} ELSE {len(CHAT.other.before) - 2 + len(CHAT.other.after)} + length({_escaped("role")}) END AS size FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _remainder(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo ``mod``; a row without doc_id has none."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def _held_out(mod: int, remainder: int) -> Column:
    """Whether labels of a row stay unseen; a row without doc_id has no label and isn't held out."""
    return F.coalesce(_remainder(mod) == remainder, F.lit(False)).alias("held_out")


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(_remainder(5) != 0))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(5, 0), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = texts(spark, sf_dir), table(spark, sf_dir, "labels")
    tagger = fit_toxicity(docs, labels.where(_remainder(4) != 2))
    scored = score_toxicity(docs, tagger)
    return scored.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("spans"))


def _span_digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, in order, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(texts(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_span_digest(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"), _span_digest(F.col("spans"), KINDS).alias("spans"))


@_query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(texts(spark, sf_dir))


@_query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, bpe = encode_texts(texts(spark, sf_dir).select("doc_id", "text"), BpeParams(ranks_path()))
    ids = F.col("ids")
    read = coded.select("doc_id", "ids", bpe.decode(ids).alias("bytes"))
    # Stored, so that whoever reads the result doesn't carry the literal maps along.
    return stored(read.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(bpe.little_endian(ids), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")), "bpe")


@_query
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance"] = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), bw AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS (
  SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM dw
), bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM bw),
names AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
coded AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, crc
), source AS (SELECT bucket, count(*) AS s FROM df JOIN coded USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM bf JOIN coded USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS sa, (SELECT coalesce(sum(t), 0) FROM target) AS ta),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (ta + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket), sums
), means AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS g FROM df JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (g - ((g % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS noise
  FROM dw LEFT JOIN means USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS total FROM scored WHERE n >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score,
  CASE WHEN place <= 25 * total // 100 THEN CAST(place AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(texts(spark, sf_dir))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM places GROUP BY lang, k, g HAVING count(*) >= 100),
longer AS (SELECT lang, g[1:k - 1] AS g, f FROM counts WHERE k > 2 UNION ALL SELECT lang, g[2:k] AS g, f FROM counts WHERE k > 2),
kept AS (SELECT * FROM counts c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = c.lang AND o.g = c.g AND o.f >= c.f)),
cuts AS (SELECT lang, g, k, f, unnest(range(1, k)) AS j FROM kept),
scored AS (
  SELECT c.lang, c.g, c.j, c.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN counts y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k] JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
