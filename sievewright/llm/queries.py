"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, counts, hmm, neardup, packing, pii, quality, snapshot, topk, urls, viterbi, whitening, wordtable
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> bytes:
    """The content of a public tokenizer's file, read on the driver; executors get it with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as held:
        return held.read()


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.check_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.junk_keys(pages))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *(number(k) for k in range(len(pii.BASE))), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


#: The conversation that the query adds, to show that control strings survive.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # a record of another layout in the same table: its fingerprint maps it to a user's and an assistant's turn
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(EXTRA_TEXT).alias("prompt"), F.lit(EXTRA_TEXT).alias("response"))
    made = chat.format_chat(rows.unionByName(extra, allowMissingColumns=True))
    back = made.select("conv_id", "formatted", "loss_turns", chat.parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    zipped = F.arrays_zip(F.col("turns").alias("t"), F.col("loss_turns").alias("m"))
    masked = F.array_join(F.transform(F.filter(zipped, lambda z: z["m"]), lambda z: z["t"]["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), masked.alias("masked"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def op11_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return snapshot.diff(docs, snapshot.later_snapshot(docs))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.check_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


QUERIES = {
    "op1_quality": op1_quality, "op2_sentencepiece": op2_sentencepiece, "op3_urls": op3_urls, "op4_topk": op4_topk, "op5_pii": op5_pii, "op6_packing": op6_packing,
    "op7_hmm": op7_hmm, "op8_counts": op8_counts, "op9_neardup": op9_neardup, "op10_chat": op10_chat, "op11_snapshot": op11_snapshot, "op12_whitening": op12_whitening, "op13_bpe": op13_bpe,
}

_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULES = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]



def _crc_table() -> list[int]:
    """The table of the reflected CRC-32, by its rule: eight shifts for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


#: crc32 of doc_id's decimal digits, for DuckDB.
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295)"

ORACLE = {
    "op3_urls": f"""
WITH r AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
listed AS (SELECT DISTINCT host || path AS k FROM p WHERE contains(html, '***') AND contains(html, '$$$') AND contains(html, '%%%') AND host || path <> ''),
j AS (SELECT page_id, host, path, (host || path) IN (SELECT k FROM listed) AS listed,
  CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _RULES)} END AS rule,
  CASE {' '.join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _RULES)} END AS says FROM p)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_neardup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT id, n, unnest(s) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 3 * greatest(a.n, b.n) <= 4 * least(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT a, a FROM y UNION SELECT y.b, r.root FROM r JOIN y ON y.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, c.id, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, c.id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.id = c.id""",
    "op11_snapshot": f"""
WITH o AS (SELECT doc_id, text, lang, source, {_CRC} % 10 AS r FROM documents),
n AS (SELECT CASE WHEN r IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
  CASE WHEN r = 2 THEN source ELSE lang END AS lang, CASE WHEN r = 2 THEN lang WHEN r <> 4 THEN source END AS source FROM o WHERE r <> 0
  UNION ALL SELECT -1 - doc_id, text, lang, source FROM o WHERE r = 5),
p AS (SELECT n.doc_id AS key, o.doc_id AS old_key, o.text IS DISTINCT FROM n.text AS t, o.lang IS DISTINCT FROM n.lang AS l, o.source IS DISTINCT FROM n.source AS s, n.text, n.lang, n.source
  FROM o JOIN n ON o.doc_id = n.doc_id),
ou AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS i FROM o WHERE doc_id NOT IN (SELECT old_key FROM p)),
nu AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id DESC) AS i FROM n WHERE doc_id NOT IN (SELECT key FROM p)),
c AS (SELECT nu.doc_id AS key, ou.doc_id AS old_key, nu.doc_id IS NULL AS gone, nu.text, nu.lang, nu.source FROM ou FULL JOIN nu
  ON ou.i = nu.i AND ou.text IS NOT DISTINCT FROM nu.text AND ou.lang IS NOT DISTINCT FROM nu.lang AND ou.source IS NOT DISTINCT FROM nu.source),
a AS (SELECT key, old_key, CASE WHEN t OR l OR s THEN 'update' ELSE 'same' END AS op, concat_ws(',', CASE WHEN t THEN 'text' END, CASE WHEN l THEN 'lang' END, CASE WHEN s THEN 'source' END) AS changed, false AS gone, text, lang, source FROM p
  UNION ALL SELECT coalesce(key, old_key), old_key, CASE WHEN gone THEN 'delete' WHEN old_key IS NULL THEN 'insert' ELSE 'rekey' END, '', gone, text, lang, source FROM c)
SELECT key, old_key, op, changed, CASE WHEN NOT gone THEN sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) END AS row_sha256 FROM a""",
    "op10_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<#:]', '', 'g')) + 14 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
