"""One whole-table query per operator, with production parameters, and DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from washframe.llm import align, blob_ledger, bpe_tree, byte_gru, collision, importance, merkle, mixing, norm_topk
from washframe.llm import pow2_pack, rlz, set_join, weak_toxicity
from washframe.llm.common import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_REACH = """reach(a, b) AS (SELECT id, id FROM vertices UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


def query(sql: str | None = None):
    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return deco


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def op1_norm_topk(spark, sf_dir):
    """Five best integer inner products per query over all embeddings."""
    rows = documents(spark, sf_dir, "embeddings").where(norm_topk.usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), norm_topk.to_integers("embedding").alias("v"))
    out = norm_topk.top_k(rows, rows.where("id % 50 = 0"), 5)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query()
def op2_importance_resample(spark, sf_dir):
    """Importance resampling towards the documents labelled as good; the kept share
    is the labelled share of good ones (all without labels, none without a good one)."""
    labels = documents(spark, sf_dir, "labels").where("quality IN (0, 1)")
    share = labels.agg(F.avg("quality")).first()[0]
    share = 1.0 if share is None else share
    good = labels.where("quality = 1").select("doc_id").distinct()
    return importance.resample(documents(spark, sf_dir), good, share)


@query(r"""WITH w AS (SELECT doc_id, """ + _WORDS.format(text="coalesce(text, '')") + r""" AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN least USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(g.j) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (g.j IS NULL) AS t
  FROM word LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""")
def op3_rlz_dedup(spark, sf_dir):
    """Words left when 13-word windows of earlier documents are removed."""
    return rlz.SubstringDedup(documents(spark, sf_dir)).cleaned().drop("kept_text")


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, """ + _WORDS.format(
    text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + r""" AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
vertices AS (SELECT doc_id AS id FROM documents), """ + _REACH + """
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN comp ON doc_id = id""")
def op4_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have Jaccard >= 0.9."""
    return set_join.JaccardJoin(documents(spark, sf_dir), 90, 100, 3).components()


@query("""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
vertices AS (SELECT vec_id AS id FROM embeddings), """ + _REACH + """
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON vec_id = id LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) ON u = vec_id""")
def op5_collision_dedup(spark, sf_dir):
    """Links and components of embeddings of equal label with cosine >= 0.93."""
    return collision.near_duplicates(documents(spark, sf_dir, "embeddings"), 0.93)


def _ledger_sql() -> str:
    parts = []
    for k, r in enumerate(blob_ledger.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{r.kind}' AS kind, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps,
  list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS hits,
  list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x)) AS held, {r.least} AS least FROM d""")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), raw AS (" + " UNION ALL ".join(parts) + """),
m AS (SELECT doc_id, k, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[:len(hits)]) AS gap,
  unnest(hits) AS hit, unnest(held) AS held FROM raw WHERE len(hits) > 0),
s AS (SELECT *, (sum(gap + hit) OVER (PARTITION BY doc_id, k ORDER BY i))::BIGINT AS e FROM m),
f AS (SELECT doc_id, k, kind, e - hit AS a, kind || ':' || (e - hit) || ':' || e AS span FROM s WHERE held >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
  count(*) FILTER (k = 2) AS n_hex, string_agg(span, ',' ORDER BY a, k) FILTER (k < 3) AS base,
  string_agg(span, ',' ORDER BY a, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


@query(_ledger_sql())
def op6_blob_ledger(spark, sf_dir):
    """Secrets of every text, through a ledger that starts empty."""
    ledger = blob_ledger.BlobLedger(spark)
    paths = ledger.update(documents(spark, sf_dir))
    return ledger.report(paths).drop("blob", "found")


@query()
def op7_pow2_pack(spark, sf_dir):
    """Power-of-two pieces of all documents, at most 2048 tokens each."""
    import public_tokenizers
    return pow2_pack.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op8_weak_toxicity(spark, sf_dir):
    """Toxicity scores of all documents; learned outside the held-out fold."""
    docs, out = documents(spark, sf_dir), byte_gru.held_out()
    model = weak_toxicity.fit(docs.where(~out), documents(spark, sf_dir, "labels").where(~out))
    return weak_toxicity.score(docs, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_byte_gru(spark, sf_dir):
    """Languages of all documents; learned outside the held-out fold."""
    docs, out = documents(spark, sf_dir), byte_gru.held_out()
    model = byte_gru.fit(docs.where(~out))
    return byte_gru.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "lang_pred", "score")


@query()
def op10_water_mix(spark, sf_dir):
    """Repetitions that mix all documents' sources by weights 1, 2, 3, repeating."""
    return mixing.Mixture(documents(spark, sf_dir)).plan()


def _merkle_sql() -> str:
    def field(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"

    def leaf(chars):
        return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", chars, "text")) + ")"

    def tree(name, key, start):
        return f"""{name}(k, lvl, pos, h, n) AS ({start} UNION ALL
  SELECT k, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1
  GROUP BY k, lvl, pos // 2, n)"""

    def side(name):
        return f"""SELECT a.k, a.pos, t.lvl, CASE WHEN b.h IS NULL THEN '-' WHEN b.pos < a.pos >> t.lvl THEN 'L' || b.h
  ELSE 'R' || b.h END AS e FROM {name} a JOIN (SELECT DISTINCT k, lvl FROM {name} WHERE n > 1) t ON t.k IS NOT DISTINCT FROM a.k
  LEFT JOIN {name} b ON b.k IS NOT DISTINCT FROM a.k AND b.lvl = t.lvl AND b.pos = xor(a.pos >> t.lvl, 1) WHERE a.lvl = 0"""

    return f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(
  list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS changed, n_chars IS NOT NULL AND coalesce(
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 7 = 0, false) AS hit FROM documents, tab),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
{tree("up", "lang", "SELECT lang, 0, pos, leaf, n FROM l")},
s AS (SELECT k AS lang, h AS subroot, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM up WHERE n = 1),
{tree("top", "1", "SELECT 1, 0, place, subroot, n FROM s")},
low AS ({side("up")}), high AS ({side("top")}),
w AS (SELECT l.*, subroot, (SELECT h FROM top WHERE n = 1) AS root,
  coalesce((SELECT list(e ORDER BY lvl) FROM low WHERE low.k IS NOT DISTINCT FROM l.lang AND low.pos = l.pos), [])
  || coalesce((SELECT list(e ORDER BY lvl) FROM high WHERE high.pos = s.place), []) AS w
  FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(list_filter(w, lambda e: e <> '-'), lambda e: e[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN hit THEN changed ELSE leaf END, w), lambda h, e: sha256(
    CASE WHEN e[1] = 'L' THEN e[2:] || h WHEN e[1] = 'R' THEN h || e[2:] ELSE h END)) AS folded_root,
  folded_root = root AS verified FROM w"""


@query()
def op11_anchor_align(spark, sf_dir):
    """Alignment of the tokens of two vocabularies over all documents."""
    import public_tokenizers
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.Alignment(documents(spark, sf_dir), *paths).documents()


@query(_merkle_sql())
def op12_merkle_manifest(spark, sf_dir):
    """Root, witness digest and verification of every document, every seventh tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.MerkleManifest(documents(spark, sf_dir), tampered).verified()


@query()
def op13_bpe_tree(spark, sf_dir):
    """Token digests of all documents, and those of the bytes that they decode to."""
    import public_tokenizers
    return bpe_tree.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
