"""Tokenizer alignment, Merkle manifest and tree BPE against brute force."""

import base64
import collections
import hashlib
import random
import string
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from washframe.llm import align, bpe_tree, merkle
from washframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, pairs long, lane string, place int, ids int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def mixed_text(rng, n):
    alphabets = ["abcdefgh", " \n\t\xa0", "0123456789", "'!,.-\"", "äöüßéñ漢字テスト", "\x1c\x1f\x85", "lsdtmver'", "😀👍🏽",
                 "▁ <unk>"]
    out = []
    while len(out) < n:
        out += rng.choices(rng.choice(alphabets), k=rng.choice([1, 1, 2, 3, 7, 30]))
    return "".join(out[:n])


def texts():
    rng = random.Random(5)
    fixed = [None, "", " ", "a", "one two three", "<|endoftext|> <|ENDOFTEXT|>", "  lead", "trail \n", "x" * 9000,
             "don't we'll 's", "▁ under ▁", "\x00 nul", "long " * 4000, "漢字" * 700]
    return fixed + [mixed_text(rng, rng.randint(1, 300)) for _ in range(40)] + [fixed[4]] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr", "é", "z"][i % 5] if i else "lone", None if i % 6 == 0 else f"s{i % 3}",
             None if i % 4 == 0 else i, 1, "x", 2, 3) for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (None, "no id", "en", "s", 3, 1, "x", 2, 3), (3, "other", None, "s", 3, 1, "x", 2, 3)]
    return spark.createDataFrame(rows, DOC)


# ---------------------------------------------------------------- alignment

def brute_alignment(all_texts):
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    decode = {c: b for c, b in align.byte_level_alphabet().items()}
    piece = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
             for i in range(sp.get_piece_size())]
    out, counts = [], collections.Counter()
    for text in all_texts:
        if not text:
            out.append(None)
            continue
        a = tok.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        bytes_a = [bytes(decode[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [piece[i] for i in b]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append(None)
            continue
        spans = []
        for side in (bytes_a, bytes_b):
            at, s = 0, []
            for t in side:
                s.append((at, at + len(t)))
                at += len(t)
            spans.append(s)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, (s, t) in zip(ids, sp_) if lo <= s and t <= e)
                                   for ids, sp_ in ((a, spans[0]), (b, spans[1]))))
            lo = e
        links, j0 = [], 0
        for x, (s, t) in zip(a, spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < t:
                links.append((x, b[j]))
                j += 1
        counts.update(links)
        out.append((len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for found in out:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
                     sum(counts[x] for x in links), sha(";".join(groups))))
    return rows, counts


def alignment_rows(frame):
    return collections.Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                               for r in frame.collect())


@pytest.mark.parametrize("slice_pairs", [align.SLICE_PAIRS, 200])
def test_alignment_matches_brute_force(docs, slice_pairs):
    rows = docs.collect()
    want, counts = brute_alignment([r.text for r in rows])
    aligned = align.Alignment(docs, A, B, keep_groups=True, slice_pairs=slice_pairs)
    got = aligned.documents()
    assert alignment_rows(got) == collections.Counter((r.doc_id, *w) for r, w in zip(rows, want))
    assert all(sha(r.groups) == r.groups_sha256 or not r.n_a for r in got.collect())
    assert {(r.a_id, r.b_id): r["count"] for r in aligned.pairs().collect()} == dict(counts)


def test_alignment_of_empty_table(spark):
    assert align.Alignment(spark.createDataFrame([], DOC), A, B).documents().count() == 0


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want, _ = brute_alignment([r.text for r in rows])
    assert alignment_rows(QUERIES["op11_anchor_align"](spark, SMALL)) == collections.Counter(
        (r.doc_id, *w) for r, w in zip(rows, want))


def test_memo_is_dropped_and_refilled(monkeypatch):
    plain, small = align.Aligner(A, B), align.Aligner(A, B)
    want = [plain.text(t) for t in texts()]
    monkeypatch.setattr(align, "MEMO_WINDOWS", 3)
    for t, w in zip(texts(), want):
        got = small.text(t)
        assert (got is None) == (w is None)
        assert got is None or got[:5] == w[:5] and got[5].tolist() == w[5].tolist()


def test_texts_leave_nothing_behind():
    """A worker's memory does not grow with the words it has met."""
    aligner = align.Aligner(A, B)

    def held():
        return {k: len(v) for k, v in vars(aligner).items() if hasattr(v, "__len__")}
    before = held()
    many = [f"w{k} x{k * k}yz, {chr(0x4e00 + k)}" for k in range(300)]
    want, _ = brute_alignment(many)
    got = [aligner.text(t) for t in many]
    assert [g and g[:4] for g in got] == [(w[0], w[1], w[2], w[3]) for w in want]
    assert held() == before


# ----------------------------------------------------------------- manifest

def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, more=0):
    chars = None if r.n_chars is None else r.n_chars + more
    return sha("".join(field(x) for x in (r.doc_id, r.source, r.lang, chars, r.text)))


def tree(nodes):
    """(root, per node its list of (sibling on the left, sibling on the right))."""
    paths, level, below = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        nxt, held = [], []
        for k in range(0, len(level), 2):
            run = level[k:k + 2]
            for side in range(len(run)):
                for i in below[k + side]:
                    paths[i].append(("".join(run[:side]), "".join(run[side + 1:])))
            nxt.append(sha("".join(run)))
            held.append(sum(below[k:k + 2], []))
        level, below = nxt, held
    return level[0], paths


def brute_manifest(rows):
    lanes = collections.defaultdict(list)
    for r in rows:
        lanes[r.lang].append(r)
    names = sorted(lanes, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        lanes[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in lanes[name]])
    root, tops = tree([trees[n][0] for n in names])
    out = collections.Counter()
    for name, top in zip(names, tops):
        for r, path in zip(lanes[name], trees[name][1]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            at = leaf(r, 1 if hit else 0)
            for left, right in path + top:
                at = sha(left + at + right)
            proof = sha("".join(a + b for a, b in path + top))
            out[r.doc_id, leaf(r), trees[name][0], root, proof, at, at == root] += 1
    return out


def manifest_rows(frame):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                               for r in frame.collect())


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


@pytest.mark.parametrize("block", [2, 256])
def test_manifest_matches_brute_force(docs, block):
    got = merkle.MerkleManifest(docs, tampered(), block=block).verified()
    want = brute_manifest(docs.collect())
    assert manifest_rows(got) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 9])
def test_manifest_of_one_language(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "id AS n_chars")
    got = merkle.MerkleManifest(docs, tampered(), block=4)
    assert manifest_rows(got.verified()) == brute_manifest(docs.collect())


def test_manifest_of_empty_table(spark):
    got = merkle.MerkleManifest(spark.createDataFrame([], DOC), tampered())
    assert got.verified().count() == 0 and got.root is None


def test_open_tree_extends_witnesses():
    for n in range(1, 40):
        grown, nodes = merkle.OpenTree(), [sha(str(i)) for i in range(n)]
        for x in nodes:
            grown.append(x)
        root = grown.close(merkle.height_of(n, 64))
        want, paths = tree(nodes)
        assert root == want
        assert [["L" + a if a else "R" + b if b else "-" for a, b in p] for p in paths] == grown.witness


# ----------------------------------------------------------------- tree BPE

def plain(path=MULTI):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf_size", [1, 2, 3, 5, 17, 64])
def test_tree_equals_library(leaf_size):
    rng, codec, want = random.Random(leaf_size), bpe_tree.TreeCodec(MULTI, leaf=leaf_size), plain()
    for t in [mixed_text(rng, rng.randint(0, 260)) for _ in range(300)]:
        assert codec.encode(t) == want.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_long_matches_are_joined_by_tokens(monkeypatch):
    rng, codec, want, joined = random.Random(2), bpe_tree.TreeCodec(MULTI), plain(), []
    inner = codec._join_tokens
    monkeypatch.setattr(codec, "_join_tokens", lambda *a: joined.append(inner(*a)) or joined[-1])
    letters = "".join(rng.choices(string.ascii_lowercase, k=30_000))
    for t in (letters, "x" * 20_000, " " * 20_000 + "x", "'" * 9_000 + "s", "7" * 9_000, "漢字" * 3_000, "ab " * 9_000,
              "-" * 9_999 + letters[:9_999] + "'" * 4_000):
        assert codec.encode(t) == want.encode_ordinary(t)
    assert sum(j is not None for j in joined) > 20


def test_tokens_are_merges_of_their_own():
    """Every token is the encoding of its bytes, so pairs of tokens tell a join's truth."""
    want = plain()
    assert all(want._encode_single_piece(t) == [r] for t, r in bpe_tree.read_ranks(MULTI).items())
    assert bpe_tree.PATTERN == P.PATTERN == align.PATTERN


def test_tree_rows(spark, docs):
    want = plain()
    got = collections.Counter(map(tuple, bpe_tree.digests(docs, MULTI).collect()))
    ids = [(r.doc_id, want.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()]
    assert got == collections.Counter(
        (d, len(x), sha(b"".join(i.to_bytes(4, "little") for i in x)), sha(t)) for d, x, t in ids)
    encoded = bpe_tree.encode(docs, MULTI)
    assert sorted(map(str, encoded.collect())) == sorted(str(r) for r in spark.createDataFrame(
        [(d, x) for d, x, _ in ids], "doc_id long, ids array<int>").collect())
    back = collections.Counter((r.doc_id, bytes(r.decoded)) for r in bpe_tree.decode(encoded, MULTI).collect())
    assert back == collections.Counter((d, t) for d, _, t in ids)
    assert bpe_tree.digests(docs.limit(0), MULTI).count() == 0


def test_tree_query(spark):
    want = plain()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in QUERIES["op13_bpe_tree"](spark, SMALL).collect()}
    assert got == {r.doc_id: (len(want.encode_ordinary(r.text)), sha(r.text)) for r in rows}
