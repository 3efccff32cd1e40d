"""Pipeline stages and registered queries on planted rows, against brute force."""

import collections
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from washframe.llm import blob_ledger, byte_gru, collision, common, importance, norm_topk, pow2_pack
from washframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ODD = ["score", "lang_pred", "shares", "row", "blob", "found", "_blob", "_found", "_new", "key", "component_id"]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def least_linked(rows):
    sets, head = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    ids = sorted(sets)
    again = True
    while again:
        again = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and x and y and 5 * len(x & y) >= 4 * len(x | y) and head[a] != head[b]:
                    head[a] = head[b] = min(head[a], head[b])
                    again = True
    return head


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of the small table, near copies, secrets, nulls and clashing columns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(40).collect()]
    rng, extra = random.Random(1), []
    for k, (i, text, lang, source, n) in enumerate(rows[:12]):
        words = text.split(" ")
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
            extra.append((1000 + k, " ".join(words), lang, source, n))
        extra.append((2000 + k, text + " password = hunter22secret AKIA" + "Q" * 20, lang, source, n))
    extra += [(3000, None, "en", None, None), (3001, "", None, "src1", 0), (3002, "ab", "en", "src1", 2)]
    out = spark.createDataFrame(rows + extra, docs.schema)
    return out.select("*", *[F.lit(k).alias(c) for k, c in enumerate(ODD)])


def ids_of(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_with_clashing_columns(spark, planted):
    kept = corpus_pipeline.language(spark, planted, SMALL)
    plain = corpus_pipeline.language(spark, planted.drop(*ODD), SMALL)
    assert kept.columns == planted.columns and ids_of(kept) == ids_of(plain) != []


def test_near_copies_keep_the_least_of_each_group(spark, planted):
    head = least_linked([(r.doc_id, r.text) for r in planted.collect()])
    assert sum(a != b for a, b in head.items()) > 5
    kept = corpus_pipeline.near_copies(spark, planted, SMALL)
    assert ids_of(kept) == sorted(i for i, h in head.items() if i == h)
    assert kept.columns == planted.columns


def brute_masked(text):
    spans = []
    for rule in blob_ledger.RULES:
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                spans.append(m.span())
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_secrets_are_masked_and_columns_stay(spark, planted):
    masked = corpus_pipeline.secrets(spark, planted, SMALL)
    assert masked.columns == planted.columns
    want = {r.doc_id: None if r.text is None else brute_masked(r.text) for r in planted.collect()}
    got = {r.doc_id: r for r in masked.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert sum("[secret]" in (t or "") for t in want.values()) >= 12
    assert all([r[c] for c in ODD] == list(range(len(ODD))) for r in got.values())


def test_stages_on_empty_table(spark, planted):
    at = planted.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
        assert at.count() == 0


def test_run_equals_its_stages(spark):
    at = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SMALL)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = collections.Counter(map(tuple, at.select(*cols).collect()))
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, SMALL).select(*cols).collect())) == want


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|endoftext|>y", "<|StartOfText|><|startoftext|>",
                                  "no special <| here |>", "A<|ENDOFTEXT|>1, 2. don't"])
def test_special_tokens_in_any_case(text):
    encoder = pow2_pack.ChunkEncoder(P.path("word_bpe_49k.json"))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids([text])[0], dtype="<u4").tolist() == want


def test_other_vocabularies_are_encoded_whole():
    encoder = pow2_pack.ChunkEncoder(P.path("byte_bpe_50k.json"))
    text = "Upper lower, 12  spaces\n"
    assert not encoder.by_words
    assert np.frombuffer(encoder.ids([text])[0], dtype="<u4").tolist() == encoder.tokenizer.encode(
        text, add_special_tokens=False).ids


def test_top_k_with_repeated_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vec = rng.integers(-9, 9, (60, 4)).tolist()
    rows = list(enumerate(vec)) + [(0, vec[0]), (0, vec[0]), (20, vec[5]), (7, vec[7])]
    items = spark.createDataFrame(rows, "id long, v array<long>")
    monkeypatch.setattr(norm_topk, "VISITS", 1)
    got = norm_topk.top_k(items, items.where("id % 10 = 0"), 5, group_values=40)
    queries = {}
    for i, v in rows:
        if i % 10 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = []
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_labels_of_any_type(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    vec = np.concatenate([base, base + 0.01 * rng.standard_normal((6, 8))]).tolist()
    rows = [(i, f"label {i % 3}", v) for i, v in enumerate(vec)] + [(50, None, vec[0]), (None, "label 0", vec[0])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in collision.near_duplicates(frame, 0.93).collect()}
    assert got[50] == (0, 50) and got[None] == (0, None)
    assert all(got[i] == (1, i % 6) for i in range(12))


def test_importance_weights_by_hand(spark):
    """Log weights from plain counts of the same buckets."""
    rows = [(i, t) for i, t in enumerate(["good words here", "bad words there", "Good words", None, "", "x " * 30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(0,), (2,), (2,)], "doc_id long")

    def grams(text):
        w = re.findall(r"\S+", (text or "").lower())
        return [*[(x,) for x in w], *zip(w, w[1:])]

    place = {}
    for g in {g for _, t in rows for g in grams(t)}:
        import pyarrow as pa
        from washframe.llm.words import gram_hashes, word_hashes
        _, _, h = next(iter(word_hashes(pa.array([" ".join(g)]), lower=True)))
        place[g] = int(gram_hashes(h, len(g))[0] % np.uint64(importance.BUCKETS))
    counts = np.ones((2, importance.BUCKETS))
    for i, t in rows:
        for g in grams(t):
            counts[1, place[g]] += 1
            counts[0, place[g]] += i in (0, 2)
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    got = {r.doc_id: r for r in importance.resample(docs, good, 0.5).collect()}
    for i, t in rows:
        assert abs(got[i].log_weight - sum(ratio[place[g]] for g in grams(t))) < 1e-9
    assert sum(r.kept for r in got.values()) == 3
    assert not any(r.kept for r in importance.resample(docs, good, 0.0).collect())


def test_sample_of_a_hot_language(spark, monkeypatch):
    monkeypatch.setattr(byte_gru, "SAMPLE_DOCS", 7)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text",
                                        "CASE WHEN id < 1990 THEN 'en' ELSE 'fr' END AS lang")
    got = byte_gru._sample(docs.union(docs), 3, "doc_id", "text", "lang", 1)
    per = collections.defaultdict(set)
    for r in got.collect():
        per[r.lang].add(r.doc_id)
    order = docs.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("h")).collect()
    for lang in ("en", "fr"):
        want = sorted((r.h, r.doc_id) for r in order if r.lang == lang)[:7]
        assert per[lang] == {d for _, d in want}


def test_byte_slices_cover_all_rows():
    import pyarrow as pa
    texts = ["a" * n for n in (0, 5, 100, 3, 3, 0, 50, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["i", "t"])
    parts = list(common.byte_slices(batch, 1, 20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(9)) and len(parts) > 2
    assert list(common.byte_slices(batch.slice(0, 0), 1)) == []


@pytest.mark.parametrize("name", ["op2_importance_resample", "op7_pow2_pack", "op8_weak_toxicity", "op9_byte_gru",
                                  "op10_water_mix"])
def test_queries_without_sql_cover_the_table(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()
    got = QUERIES[name](spark, SMALL).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs}


def test_least_scores_come_from_all_learning_documents(spark, monkeypatch):
    """Not from as many documents as training may use."""
    monkeypatch.setattr(byte_gru, "SAMPLE_DOCS", 3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(120)
    model = byte_gru.fit(docs)
    by = collections.defaultdict(list)
    for r in byte_gru.predict(docs, model).where("lang = lang_pred").collect():
        by[r.lang].append(r.score)
    assert max(map(len, by.values())) > 3
    for share in (0.0, 0.4):
        got = byte_gru.least_scores(docs, model, share)
        assert got.keys() == by.keys()
        assert all(abs(got[k] - np.quantile(v, share)) < 1e-5 for k, v in by.items())
    assert byte_gru.least_scores(docs, None, 0.5) == {} == byte_gru.least_scores(docs.limit(0), model, 0.5)


def test_arrow_batches_are_bounded(spark):
    from washframe.llm import common

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])
    rows = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 100000) AS text")
    got = [r.n for r in common.arrow_map(rows, sizes, "n long").collect()]
    assert len(got) > 5 and max(got) < 2 * common.ARROW_BYTES
