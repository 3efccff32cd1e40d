"""The corpus operators against brute force on small tables with nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from washframe.llm import (blob_ledger, byte_gru, collision, importance, mixing, norm_topk, pow2_pack, rlz, set_join,
                           weak_toxicity, words)

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, key long"   # key: a clashing extra name


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 120, 30)]
    texts = [*base, *base[:6], *[t + " tail" for t in base[:8]], base[0].replace(" ", "\t\n"), "", None, "  ", "one", "ONE",
             "two words", " ".join(rng.choice(vocab, 30_000)), "x" * 5000, "é ü ß", base[3] + " " + base[5] + " " + base[7]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    return rows + [(rows[2][0], *rows[2][1:]), (None, "no id " * 20, "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_word_hashes_match_words():
    import pyarrow as pa
    texts = [t for _, t, *_ in corpus()] + ["a" * 3_000_000 + " b", "b " * 1_500_000]
    names = {}
    for row, offs, h in words.word_hashes(pa.array(texts, pa.string())):
        for d in range(len(offs) - 1):
            mine = split(texts[row + d])
            assert offs[d + 1] - offs[d] == len(mine)
            for w, x in zip(mine, h[offs[d]:offs[d + 1]].tolist()):
                assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vec = rng.integers(-9, 9, (80, 6)).tolist() + [[0] * 6, [1, 2], [2, 1], [3 * 10 ** 9] * 6]
    rows = list(enumerate(vec)) + [(0, vec[0]), (None, vec[1]), (200, None), (201, [])]
    items = spark.createDataFrame(rows, "id long, v array<long>")
    got = norm_topk.top_k(items, items.where("id % 7 = 0").dropDuplicates(["id"]), 3, group_values=120)
    live = [(i, v) for i, v in rows if i is not None and v]
    want = []
    for q, v in dict(live).items():
        if q % 7 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in live if i != q and len(c) == len(v))[:3]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    none = items.limit(0)
    assert norm_topk.top_k(none, none).count() == 0


def test_importance(spark, docs):
    good = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = importance.resample(docs, good, 0.5).collect()
    assert len(got) == len(corpus()) and sum(r.kept for r in got) == round(0.5 * len(got))
    assert all(r.log_weight == 0 for r in got if r.doc_id is not None and not split(corpus()[r.doc_id][1]))
    order = sorted(got, key=lambda r: r["rank"])
    assert all(a.gumbel_key >= b.gumbel_key for a, b in zip(order, order[1:]))
    again = importance.resample(docs.repartition(3), good, 0.5).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(r.doc_id, r.kept) for r in again}
    assert importance.resample(empty(spark), good, 0.5).count() == 0
    b = {row: x for row, x in importance._row_buckets(__import__("pyarrow").array(["a b a b", ""]))}
    assert len(b[0]) == 7 and len(set(b[0].tolist())) == 4 and len(b[1]) == 0


def brute_cut(rows, size=13):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        w = split(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i:i + size])] < d:
                gone[i:i + size] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"block_words": 200, "task_words": 400, "anchor_words": 2}])
def test_substring_dedup(spark, docs, sizes):
    got = rlz.SubstringDedup(docs, **sizes).cleaned().drop("kept_text")
    assert collections.Counter(map(tuple, got.collect())) == brute_cut([r[:2] for r in corpus()])


def test_substring_dedup_empty(spark):
    assert rlz.SubstringDedup(empty(spark)).cleaned().count() == 0


def brute_join(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[d] = s
    ids = sorted(d for d in sets if d is not None)
    head = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and head[b] > head[a]:
                    head[b] = head[a]
    return collections.Counter((d, len(sets[d]), head.get(d)) for d, _ in rows)


@pytest.mark.parametrize("num,den,price", [(90, 100, 4.0), (4, 5, 0.01), (1, 2, 0.01)])
def test_jaccard_join(docs, num, den, price):
    join = set_join.JaccardJoin(docs, num, den, 3, deletion_price=price)
    assert collections.Counter(map(tuple, join.components().collect())) == brute_join(
        [r[:2] for r in corpus()], 3, num, den)


def test_jaccard_families(spark, monkeypatch):
    """A large family of texts that are alike but mostly not linked."""
    monkeypatch.setattr(set_join, "FAMILY_KEY", 4)
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for j in rng.integers(0, 60, int(rng.integers(1, 5))):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    join = set_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 3)
    assert collections.Counter(map(tuple, join.components().collect())) == brute_join(rows, 3, 80, 100)
    sets = [frozenset(tuple(t.split()[i:i + 3]) for i in range(58)) for _, t in rows]
    want = {(i, j) for j in range(70) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert {(r.u, r.v) for r in join.links().collect()} == want


@pytest.mark.parametrize("rounds", [1, 2])
def test_jaccard_rounds_run_out(spark, monkeypatch, rounds):
    """Pairs that are left when the last round of stars is over are verified too."""
    monkeypatch.setattr(set_join, "MAX_STAR_ROUNDS", rounds)
    monkeypatch.setattr(set_join, "STALLED", 1e9)   # only the number of rounds ends them
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        w = [f"t{j}" for j in range(60)]
        for j in rng.integers(0, 60, int(rng.integers(1, 6))):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    calls, verify = [], set_join.JaccardJoin._verify
    monkeypatch.setattr(set_join.JaccardJoin, "_verify", lambda self, pairs: calls.append(1) or verify(self, pairs))
    join = set_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 3)
    assert collections.Counter(map(tuple, join.components().collect())) == brute_join(rows, 3, 80, 100)
    assert len(calls) == rounds + 2   # the first stars, all rounds, what is left


def test_jaccard_unlinked_members_of_a_key(spark, monkeypatch):
    """Members of a key that are alike only there never become rows of pairs; those that
    are linked across its blocks do."""
    monkeypatch.setattr(set_join, "KEY_BLOCK", 16)
    monkeypatch.setattr(set_join, "BLOCK_WORDS", 32)
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(9999)}" for _ in range(rnd.choice([30, 60, 150]))) for _ in range(90)]
    texts += [t + " more" for t in texts[:30]]
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts)]
    join = set_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 3)
    members = spark.createDataFrame([(i % 2 and k, d, False, False, d) for i, (d, _) in enumerate(rows) for k in (1, 2)],
                                    "key long, doc long, low boolean, cut boolean, comp long").distinct()
    got = {tuple(r) for r in join._near_in_keys(members).collect()}
    sets = {d: {tuple(w[i:i + 3]) for i in range(len(w) - 2)} for d, w in ((d, t.split()) for d, t in rows)}
    keys = {d: i % 2 for i, (d, _) in enumerate(rows)}
    linked = {(u, v) for u in sets for v in sets if u < v and keys[u] == keys[v]
              and 100 * len(sets[u] & sets[v]) >= 80 * len(sets[u] | sets[v])}
    assert len(linked) == 30 and linked <= got and len(got) < 3 * len(linked)
    low = members.withColumn("low", F.lit(True))
    assert not join._near_in_keys(low).count() and not join._near_in_keys(members.withColumn("comp", F.lit(1))).count()


def test_jaccard_pairs_of_a_common_passage_are_few(spark, monkeypatch):
    """A passage shared by documents that do not link makes no pairs with the square of their number."""
    monkeypatch.setattr(set_join, "FAMILY_SHARE", 99.0)
    common = " ".join(f"c{i}" for i in range(16))
    texts = [common + " " + " ".join(f"d{i}x{j}" for j in range(12)) for i in range(150)]
    calls, verify = [], set_join.JaccardJoin._verify
    monkeypatch.setattr(set_join.JaccardJoin, "_verify", lambda self, pairs: calls.append(pairs.count()) or verify(self, pairs))
    join = set_join.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80, 100, 3)
    got = join.components().collect()
    assert len(got) == 150 and all(r["component_id"] == r["doc_id"] for r in got)
    assert sum(calls) < 5 * 150, calls


@pytest.mark.parametrize("edges, rounds", [
    ([(2, 1), (3, 1), (1, 4), (7, 5), (7, 5), (6, 6), (None, 1)], 0),    # stars already
    ([(2, 1), (3, 2), (9, 8)], 1),
    ([(i, i + 1) for i in range(1, 30)] + [(40, 35), (35, 40), (38, 40)], None),
    ([], 0)])
def test_components_end_with_the_last_change(spark, monkeypatch, edges, rounds):
    """Edges that are stars around least vertices take no round more to see it."""
    from washframe.llm import components
    stored, write = [], components.store
    monkeypatch.setattr(components, "store", lambda df, label: stored.append(label) or write(df, label))
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    heads = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in heads:
        for u, v in edges:
            if u in heads and v in heads:
                heads[u] = heads[v] = min(heads[u], heads[v])
    assert sorted(map(tuple, got.collect())) == sorted(heads.items())
    assert rounds is None or len(stored) == 1 + rounds


def test_jaccard_empty(spark):
    assert set_join.JaccardJoin(empty(spark)).components().count() == 0


def test_collisions(spark, monkeypatch):
    monkeypatch.setattr(collision, "BLOCK_ROWS", 16)
    monkeypatch.setattr(collision, "GROUP_BLOCKS", 2)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 16))
    vec = [(centre[i % 12] + 0.12 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(90)]
    rows = [(i, v, i % 12 % 2, 7) for i, v in enumerate(vec)]
    rows += [(90 + i, vec[0], 0, 7) for i in range(5)] + [(95, None, 0, 7), (96, [0.0] * 16, 0, 7), (97, vec[1], None, 7),
                                                          (98, [float("nan")] * 16, 1, 7), (99, vec[3][:4], 1, 7)]
    got = collision.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int"))
    ok = [(i, np.array(v, dtype=float), lab) for i, v, lab, _ in rows
          if v is not None and lab is not None and np.isfinite(v).all() and np.any(v)]
    pairs = [(a[0], b[0]) for a in ok for b in ok if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    links = collections.Counter(x for p in pairs for x in p)
    head = set_join.spanning(100, *(np.array(x) for x in zip(*pairs)))
    assert sorted(map(tuple, got.collect())) == [(i, links[i], int(head[i]), head[i] == i) for i in range(100)]


def test_collision_recall():
    """The calibrated count keeps pairs at the threshold."""
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 48))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93 ** 2) * b / np.linalg.norm(b, axis=1)[:, None]
    d = np.abs(a @ collision.directions(48) - b @ collision.directions(48))
    assert ((d <= collision.window(0.93)).sum(1) >= collision.least_collisions()).mean() >= 0.998


def test_ledger(spark):
    key = "AKIA" + "Q" * 16
    texts = ["password = 'hunter22x' and " + "ab12" * 8, "secret=token: abcdefgh", f"é😀 {key} {key}", None, "", f"é😀 {key} {key}",
             "API_KEY:\"abc\" token=abcdef" + "0" * 30, "-----BEGIN RSA PRIVATE KEY-----"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1)], "doc_id long, text string, blob int")
    ledger = blob_ledger.BlobLedger(spark)
    got = {r.doc_id: r for r in ledger.report(ledger.update(docs)).collect()}
    assert got[0].spans == got[None].spans == "assign:0:21,hex:27:59" and (got[0].n_assign, got[0].n_hex) == (1, 1)
    assert got[1].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest() == got[3].base_sha256
    assert got[2].spans == got[5].spans == "access:3:23,access:24:44"
    assert got[6].n_assign == 1 and got[7].spans == "pem:0:31" and got[7].base_sha256 == got[3].base_sha256
    seen = ledger.seen().count()
    assert seen == 6 * len(blob_ledger.RULES)       # blobs, not paths
    more = docs.limit(0).union(spark.createDataFrame([(9, texts[0], 1), (10, "token=zzzzzz", 1)], docs.schema))
    after = {r.doc_id: r.spans for r in ledger.report(ledger.update(more)).collect()}
    assert after == {9: got[0].spans, 10: "assign:0:12"} and ledger.seen().count() == seen + len(blob_ledger.RULES)
    clean = {r.doc_id: r for r in blob_ledger.redacted(spark, docs).collect()}
    assert clean[2].text == "é😀 [secret] [secret]" and clean[3].text is None and clean[1].text == texts[1]
    assert clean[0].blob == 1 and blob_ledger.redacted(spark, docs.limit(0)).count() == 0


def test_pack(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["İstanbul's don't 12abc <|endoftext|>x ΣΑΣ. ΟΔΟΣ, été!", "a\x1cb c", "a_. b½, c ., d!. é. f", "ﬁne, ǅ?! it's..."]
    rows = [(1000 + i, t) for i, t in enumerate(odd)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pow2_pack.pack(both, path, keep_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = collections.defaultdict(list)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        by[r.doc_id].append(r)
    for d, t in [*(r[:2] for r in corpus()), *rows]:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        mine = sorted(by[d], key=lambda r: r.start)
        assert sum(r.length for r in mine) % len(ids) == 0 and {r.doc_tokens for r in mine} == {len(ids)}
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            assert r.ids == ids[r.start:r.start + r.length].tolist()
    assert pow2_pack.pack(empty(spark), path).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    vocab, bad = [f"wordy{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vilest", "cursedly", "hatred"]
    rows = []
    for i in range(900):
        w, toxic = list(rng.choice(vocab, 40)), int(i % 6 == 0)
        if toxic:
            w[5:5 + 2] = rng.choice(bad, 2, replace=False)
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = byte_gru.held_out()
    model = weak_toxicity.fit(docs.where(~out), docs.select("doc_id", "toxic").where(~out))
    test = weak_toxicity.score(docs.where(out), model).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in test]) > 0.97
    blank = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "doc_id long, text string")
    assert all(r.score < 0.5 for r in weak_toxicity.score(blank, model).collect())
    none = weak_toxicity.fit(docs.limit(0), docs.select("doc_id", "toxic").limit(0))
    assert [r.score for r in weak_toxicity.score(blank, none).collect()] == [0.0] * 3


@pytest.mark.xfail(reason="a copied voter passes for the class: accuracies come out too low (see README)", strict=True)
def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    votes = np.stack([np.where(rng.random(6000) < p, y, ~y) for p in (0.9, 0.85, 0.8, 0.95)], axis=1)
    votes = np.concatenate([votes, votes[:, 1:2]], axis=1)     # a voter that copies another
    model, q = weak_toxicity.fit_label_model(np.where(votes, 1, 2).astype(np.int8), 0.3)
    assert ((q > 0.5) == y).mean() > 0.95 and model.correlation[1, 4] > 0.9 and model.weight[1] < 0.6
    assert abs(model.table[3, 1, 1] - 0.95) < 0.03


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = byte_gru.held_out()
    model = byte_gru.fit(docs.where(~out))
    got = byte_gru.predict(docs, model).where(out).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.9 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "a"), (2, "12 34 !", "b"), (3, "", "c"), (4, "the end of the story " * 400, "d")],
                                "doc_id long, text string, score string")
    found = {r.doc_id: r for r in byte_gru.predict(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[4].lang_pred == "en" and found[4].score == "d"
    assert byte_gru.fit(docs.limit(0)) is None
    assert byte_gru.predict(odd, None).select("lang_pred").distinct().collect()[0][0] == "und"


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = byte_gru.Model.fresh(list("abc"), 2)
    x, y = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 5)
    _, grads = byte_gru.gradients(model, x, y)
    for p, g in zip(model.params(), grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = old + step
            losses.append(byte_gru.gradients(model, x, y)[0])
        p[at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - g[at]) < 2e-3 + 0.02 * abs(g[at])
    short = byte_gru.label_positions(model, np.vstack([x, x]), np.array([14, 7, 14, 7, 14]))
    assert np.allclose(short[:7, :, 1], byte_gru.label_positions(model, x[:, 1:2])[:, :, 0], atol=1e-5)


def test_mixture(spark, docs):
    mix = mixing.Mixture(docs)
    got = mix.plan().collect()
    rows = corpus()
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == collections.Counter((d, len(split(t))) for d, t, *_ in rows)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(split(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(names, mixing.targets_by_hand([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], 3)))
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]
        assert r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in names:
        longest = max(len(split(r[1])) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= longest / 2 + 1
    again = mixing.Mixture(docs.repartition(5)).plan().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix.mixed().count() == sum(r.copies for r in got) and mix.mixed().columns == docs.columns
    assert mixing.Mixture(empty(spark)).plan().count() == 0


def test_mixture_with_two_level_prefix_sums(spark, docs, monkeypatch):
    # ranges of 2 rows: one span of all ranges, and spans of 3, choose the same rows
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    want = sorted(map(tuple, mixing.Mixture(docs).plan().collect()), key=repr)
    monkeypatch.setattr(mixing, "SPAN_RANGES", 3)
    assert sorted(map(tuple, mixing.Mixture(docs).plan().collect()), key=repr) == want
    rows = [(i, "w " * (1 + i % 5), "s") for i in range(500)] + [(1000 + i, "w", "t" if i else None) for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mixture(table, max_epochs=9)
    held = {r.skey: r for r in mix.sources.collect()}
    sized = [(r.skey, r.u, r["size"]) for r in mix.sized.collect()]
    edges = {r.skey: (r.edge, r.room) for r in mix.edges.collect()}
    for skey, row in held.items():      # the edge by hand
        sums = {}
        for s, u, size in sized:
            if s == skey:
                at = int(((u % (1 << 64)) >> 1) / float(1 << 63) * row.ranges)
                sums[at] = sums.get(at, 0) + size
        left, found = row.rest, None
        for at in sorted(sums):
            if sums[at] > left:
                found = (at, left)
                break
            left -= sums[at]
        assert (skey in edges) == (found is not None)
        if found:
            assert edges[skey][0] == found[0] and abs(edges[skey][1] - found[1]) < 1e-6


def test_mixture_fills_up_behind_a_long_document(spark):
    """A long document where the words end leaves its room to later ranges."""
    rows = [(1001 * s + i, "w " * (3750 if i == 1000 else 10), f"s{s:02}") for s in range(12) for i in range(1001)]
    got = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).plan().collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.doc_id // 1001] += r.taken
        target[r.doc_id // 1001] = r.target
    assert max(abs(taken[s] - target[s]) for s in target) <= 5 + 1e-6


def test_water_filling_is_feasible():
    got = mixing.targets_by_hand([1, 10, 1000, 0], [1, 2, 3, 1], 3)
    assert abs(sum(got) - 1011) < 1e-9 and got[0] == 3 and got[1] == 30 and got[3] == 0
