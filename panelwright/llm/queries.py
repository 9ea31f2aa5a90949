"""The operators of this folder applied to the whole test tables, one query an operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import attention, bpe, collocations, counts, language, lattice, mixing, pieces, pivots, prefixes, simhash, tokens, toxicity
from panelwright.llm.common import fold
from panelwright.session import scratch_path

QUERIES: dict = {}
ORACLE: dict = {}


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; TOKENIZER_DIR, if set, names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the documents whose fold of five is not 0."""
    return toxicity.fit(docs.filter(fold(F.col("doc_id"), 5) != 0), labels)


def language_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn languages from: those whose fold of three is not 1."""
    return docs.filter(fold(F.col("doc_id"), 3) != 1)


@query
def op1_token_table(spark, folder):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1, by_word=True)
    return tokens.checksums(tokens.read_tokens(spark, path))


@query
def op2_pivot_top_k(spark, folder):
    e = table(spark, folder, "embeddings")
    return pivots.top_k(e, e.filter(F.col("vec_id") % 20 == 0), k=20)


ORACLE["op2_pivot_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


@query
def op3_language(spark, folder):
    d = table(spark, folder, "documents")
    told = language.predict(d.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), language.fit(language_rows(d)))
    return told.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_lattice(spark, folder):
    return lattice.near_duplicates(table(spark, folder, "embeddings"), 0.98)


@query
def op5_toxicity(spark, folder):
    d = table(spark, folder, "documents")
    m = toxicity_model(d, table(spark, folder, "labels"))
    return toxicity.score(d.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), m)


@query
def op6_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), radius=4)


@query
def op7_token_counts(spark, folder):
    return counts.token_counts(table(spark, folder, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))


@query
def op8_mixing(spark, folder):
    rows = mixing.sized(table(spark, folder, "documents"))
    p = mixing.plan(rows)
    taken = mixing.copies(rows, p)
    s = mixing.source_table(spark, p).withColumnRenamed("source", "of")
    return (taken.join(s, F.col("source").eqNullSafe(F.col("of")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")))


@query
def op9_sentencepiece(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.encode(d, tokenizer("piece_bpe_32k.model"), check=True, ids=False)


@query
def op10_attention(spark, folder):
    d = table(spark, folder, "documents")
    return attention.score(d, fold(F.col("doc_id"), 7) != 2, tokenizer("piece_bpe_32k.model"))


@query
def op11_conversation_trie(spark, folder):
    c = F.col("conv_id")
    p = prefixes.paths(table(spark, folder, "conversations"))
    return prefixes.trie(prefixes.forked(p, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, most=8))


#: CRC-32 bit by bit, from its reversed polynomial.
ORACLE["op11_conversation_trie"] = """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda z: 0::BIGINT)),
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 9 AS h FROM t),
p AS (
  SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS path
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, len(path) AS n, d, path[:d] AS path FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(path[d].text)) END AS saved
  FROM m GROUP BY path, d),
up AS (
  SELECT c.path, c.saved, NOT EXISTS (SELECT 1 FROM n x WHERE x.depth = c.depth + 1 AND x.path[:c.depth] = c.path) AS leaf,
         a.d, c.path[:a.d] AS top
  FROM n c, LATERAL (SELECT unnest(range(c.depth + 1)) AS d) a),
s AS (SELECT top, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (WHERE len(path) = d + 1) AS n_children
      FROM up GROUP BY top, d)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.path LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]"""


@query
def op12_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"), most_words=3, least=10, share=50, top=2000)


ORACLE["op12_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS phrase
      FROM w, (SELECT unnest([1, 2, 3]) AS k) ks, LATERAL (SELECT unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i) x),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, pos, l.a AS l, r.a AS r,
         (1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c, LATERAL (SELECT unnest(range(1, k)) AS pos) x
  JOIN f l ON l.lang = c.lang AND l.phrase = c.phrase[:pos]
  JOIN f r ON r.lang = c.lang AND r.phrase = c.phrase[pos + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
top AS (SELECT lang, phrase, max(a) AS a FROM (
          SELECT lang, unnest([phrase[:2], phrase[2:]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN top t ON t.lang = b.lang AND t.phrase = b.phrase WHERE t.a IS NULL OR 100 * t.a < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
             array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, CAST(r.score AS BIGINT) AS score
FROM r JOIN n ON n.lang = r.lang WHERE r.rank <= 2000"""


@query
def op13_bpe(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(d, tokenizer("byte_bpe_50k.json"), ids=False, digests=True)
