"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in blocks of ``BLOCK`` bytes, in
both directions; a linear layer over both states labels every byte position,
and a document's probabilities are the mean over its positions. It is trained
here, in numpy, by backpropagation through time with Adam, on windows taken at
seeded places of a bounded sample of labelled documents (``SAMPLE_DOCS`` per
language at most, ``WINDOWS`` windows each).

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the label that sorts first; with no labelled document every text is
``und``; rows are independent of one another, so copies get equal results; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washframe.llm.common import ID_BROADCAST_ROWS, arrow_map, store
from washframe.llm.words import text_buffers
from washframe.operators.quantiles import exact_quantiles

BLOCK = 128
HIDDEN = 6
SAMPLE_DOCS = 500       # labelled documents per language that training may use
CELL_BITS = 16    # hash ranges whose row counts bound the rows that are ranked
WINDOWS = 6             # training windows of a document
TRAIN_BLOCK = 48        # bytes of a training window
STEPS = 260
BATCH = 192
_FOUND = "lang_pred string, score double, shares array<double>"
_LETTER = re.compile(r"[^\W\d_]")


def _bend(x: np.ndarray, work: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the state's activation; a gate is half of it plus a
    half. Its slope follows from its value, and it costs a third of tanh."""
    np.abs(x, out=work)
    work += 1
    x /= work
    return x


@dataclass
class Model:
    """Weights of both directions: input rows per byte (gates z, r, n), recurrent
    matrices, output layer."""
    labels: list
    wx: list
    wh: list
    wo: np.ndarray
    bo: np.ndarray

    @staticmethod
    def fresh(labels: list, seed: int) -> "Model":
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        return Model(labels, [draw(3 * h, 256), draw(3 * h, 256)], [draw(3 * h, h), draw(3 * h, h)],
                     draw(len(labels), 2 * h), np.zeros((len(labels), 1), np.float32))

    def params(self) -> list:
        return [*self.wx, *self.wh, self.wo, self.bo]


def run_direction(wx: np.ndarray, wh: np.ndarray, x: np.ndarray, keep: bool = False):
    """States (T, H, B) of a gated recurrent layer over byte columns x (T, B)."""
    steps, width, h = x.shape[0], x.shape[1], wh.shape[1]
    states = np.empty((steps, h, width), dtype=np.float32)
    state = np.zeros((h, width), dtype=np.float32)
    inp, rec, work = (np.empty((3 * h, width), dtype=np.float32) for _ in range(3))
    saved = []
    for t in range(steps):
        np.take(wx, x[t], axis=1, out=inp, mode="clip")
        np.matmul(wh, state, out=rec)
        gates, new = inp[:2 * h], inp[2 * h:]
        gates += rec[:2 * h]
        _bend(gates, work[:2 * h])
        gates *= 0.5
        gates += 0.5
        z, r = gates[:h], gates[h:]
        r_n = np.multiply(r, rec[2 * h:], out=work[:h])
        new += r_n
        _bend(new, work[:h])
        if keep:
            saved.append((state, z.copy(), r.copy(), new.copy(), rec[2 * h:].copy()))
        nxt = np.subtract(state, new, out=states[t])
        nxt *= z
        nxt += new
        state = nxt
    return states, saved


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def label_positions(model: Model, x: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Probabilities (T, labels, B) of every byte position of x (T, B). Columns
    shorter than T have ``size`` bytes; they are read backwards from their own end,
    and what is returned behind it has no meaning."""
    steps = len(x)
    ahead, _ = run_direction(model.wx[0], model.wh[0], x)
    turn = None
    if size is not None and (size < steps).any():
        # position of step t read backwards; behind the end any position will do
        turn = np.maximum(size[None, :] - 1 - np.arange(steps)[:, None], 0)
        back, _ = run_direction(model.wx[1], model.wh[1], np.take_along_axis(x, turn, axis=0))
    else:
        back, _ = run_direction(model.wx[1], model.wh[1], x[::-1])
    seen = np.matmul(model.wo[:, HIDDEN:], back)
    seen = seen[::-1] if turn is None else np.take_along_axis(seen, turn[:, None, :], axis=0)
    return _softmax(np.matmul(model.wo[:, :HIDDEN], ahead) + seen + model.bo)


def _back_direction(wh: np.ndarray, x: np.ndarray, saved: list, dstates: np.ndarray):
    """Gradients of the input rows and the recurrent matrix, last step first."""
    h, width = wh.shape[1], x.shape[1]
    dwx, dwh, dnext = np.zeros((256, 3 * h), np.float32), np.zeros_like(wh), np.zeros((h, width), np.float32)
    for t in range(len(saved) - 1, -1, -1):
        state, z, r, new, rec_n = saved[t]
        d = dstates[t] + dnext
        dz = d * (state - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dn = d * (1 - z) * (1 - np.abs(new)) ** 2
        dr = dn * rec_n * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        drec = np.concatenate([dz, dr, dn * r])
        np.add.at(dwx, x[t], np.concatenate([dz, dr, dn]).T)
        dwh += drec @ state.T
        dnext = d * z + wh.T @ drec
    return dwx.T, dwh


def gradients(model: Model, x: np.ndarray, y: np.ndarray):
    """(loss, gradients) of the mean cross entropy over all positions."""
    ahead, sa = run_direction(model.wx[0], model.wh[0], x, keep=True)
    back, sb = run_direction(model.wx[1], model.wh[1], x[::-1], keep=True)
    both = np.concatenate([ahead, back[::-1]], axis=1)
    p = _softmax(np.matmul(model.wo, both) + model.bo)
    rows = np.arange(x.shape[1])
    loss = -float(np.log(p[:, y, rows] + 1e-9).mean())
    p[:, y, rows] -= 1
    p /= x.size
    dwo = np.einsum("tlb,thb->lh", p, both)
    dboth = np.matmul(model.wo.T, p)
    ga = _back_direction(model.wh[0], x, sa, dboth[:, :HIDDEN])
    gb = _back_direction(model.wh[1], x[::-1], sb, dboth[::-1, HIDDEN:])
    return loss, [ga[0], gb[0], ga[1], gb[1], dwo, p.sum(axis=(0, 2))[:, None]]


def train(windows: np.ndarray, y: np.ndarray, labels: list, seed: int = 3, steps: int = STEPS) -> Model:
    """Fit on windows (N, TRAIN_BLOCK) of bytes with label numbers y; classes are
    drawn evenly."""
    model, rng = Model.fresh(labels, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(y == c) for c in range(len(labels))]
    m, v = ([np.zeros_like(p) for p in model.params()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by[c]) for c in rng.integers(0, len(labels), BATCH)])
        _, grads = gradients(model, windows[pick].T.astype(np.int64), y[pick])
        rate = 0.02 * (1 - 0.9 * step / steps)
        for p, g, a, b in zip(model.params(), grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-7)
    return model


def _window_rows(seed: int):
    def run(batches):
        for batch in batches:
            langs, ids = batch.column(2).to_pylist(), batch.column(0).to_pylist()
            raw, offs = text_buffers(batch.column(1))
            out, lang = [], []
            for i in range(len(langs)):
                n = int(offs[i + 1] - offs[i])
                if n < TRAIN_BLOCK:
                    continue
                rng = np.random.default_rng([seed, abs(ids[i] or 0)])
                for a in rng.integers(0, n - TRAIN_BLOCK + 1, WINDOWS):
                    out.append(raw[offs[i] + a:offs[i] + a + TRAIN_BLOCK].tobytes())
                    lang.append(langs[i])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())],
                                             names=["lang", "w"])
    return run


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that learning never sees: crc32 of the id as text, remainder 1 of 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _sample(docs: DataFrame, seed: int, id_col: str, text_col: str, lang_col: str, least_bytes: int) -> DataFrame:
    """doc_id, text and lang of at most ``SAMPLE_DOCS`` labelled documents a language."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(f"lang IS NOT NULL AND octet_length(text) >= {least_bytes}")
    # A threshold on the hash, from counts by language and hash range, leaves a few rows
    # more than needed; the exact cut ranks those alone.
    drawn = store(rows.select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("h")).distinct(), "sample-ids")
    cell = F.shiftright("h", 64 - CELL_BITS)
    cells = drawn.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n")
    last = cells.withColumn("before", before).where(f"before < {SAMPLE_DOCS}").groupBy("lang").agg(F.max("cell").alias("last"))
    near = drawn.withColumn("cell", cell).join(last, "lang").where("cell <= last")
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = store(near.withColumn("n", F.row_number().over(order)).where(f"n <= {SAMPLE_DOCS}").select("doc_id", "lang"),
                "sample-ids")
    out = rows.join(F.broadcast(ids) if ids.count() <= ID_BROADCAST_ROWS else ids, ["doc_id", "lang"], "left_semi")
    return out.select("doc_id", "text", "lang")


def fit(docs: DataFrame, seed: int = 3, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """Train on ``docs`` (only rows to learn from); None without labelled rows."""
    few = _sample(docs, seed, id_col, text_col, lang_col, TRAIN_BLOCK)
    got = arrow_map(few, _window_rows(seed), "lang string, w binary").toArrow()
    if not got.num_rows:
        return None
    langs = got["lang"].to_pylist()
    labels = sorted(set(langs))
    windows = np.frombuffer(b"".join(got["w"].to_pylist()), dtype=np.uint8).reshape(-1, TRAIN_BLOCK)
    y = np.array([labels.index(x) for x in langs])
    order = np.lexsort((*windows.T[:8][::-1], y))   # the order of collected rows may vary
    return train(windows[order], y[order], labels, seed)


def pooled(model: Model, raw: np.ndarray, offs: np.ndarray, blocks: int = 2048) -> np.ndarray:
    """Sums of position probabilities (texts, labels) of texts in a byte buffer."""
    out = np.zeros((len(offs) - 1, len(model.labels)))
    n = np.diff(offs)
    text = np.repeat(np.arange(len(n)), -(-n // BLOCK))
    first = np.concatenate([[0], np.cumsum(-(-n // BLOCK))])[:-1]
    start = offs[text] + (np.arange(len(text)) - first[text]) * BLOCK
    size = np.minimum(offs[text + 1] - start, BLOCK)
    order = np.argsort(-size, kind="stable")    # whole blocks first, so few columns are padded
    for lo in range(0, len(order), blocks):
        b = order[lo:lo + blocks]
        n_b = size[b]
        at = start[b][None, :] + np.arange(int(n_b[0]))[:, None]
        x = raw[np.minimum(at, len(raw) - 1)].astype(np.intp)
        p = label_positions(model, x, n_b)
        if n_b[-1] < n_b[0]:
            p *= (np.arange(int(n_b[0]))[:, None] < n_b[None, :])[:, None, :]
        np.add.at(out, text[b], p.sum(axis=0).T)
    return out


def _predict_rows(model: Model | None):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            n = len(texts)
            lang, score = np.full(n, "und", dtype=object), np.zeros(n)
            shares: list = [None] * n
            if model is not None and n:
                raw, offs = text_buffers(texts)
                letter = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()])
                for lo in range(0, n, 256):
                    hi = min(n, lo + 256)
                    p = pooled(model, raw, offs[lo:hi + 1])
                    p /= np.maximum(np.diff(offs[lo:hi + 1]), 1)[:, None]
                    for i in np.flatnonzero(letter[lo:hi]):
                        best = int(p[i].argmax())
                        lang[lo + i], score[lo + i] = model.labels[best], min(1.0, float(p[i, best]))
                        shares[lo + i] = p[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(shares, pa.list_(pa.float64()))],
                names=["row", "lang_pred", "score", "shares"])
    return run


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and the shares of all labels (in the order of
    ``model.labels``)."""
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema.simpleString()
    out = arrow_map(rows, _predict_rows(model), f"row {kind}, {_FOUND}")
    return out.select("row.*", *[F.col(c).alias(name) for c, name in result_names(docs).items()])


def result_names(docs: DataFrame) -> dict[str, str]:
    """Names of the columns that ``predict`` adds: none that ``docs`` has."""
    names = {}
    for c in ("lang_pred", "score", "shares"):
        names[c] = c
        while names[c].lower() in {x.lower() for x in docs.columns}:
            names[c] += "_found"
    return names


def least_scores(docs: DataFrame, model: Model | None, share: float, text_col: str = "text",
                 lang_col: str = "lang") -> dict[str, float]:
    """Per language the score below which ``share`` of its labelled documents lie, of
    those that the network labels right: all of ``docs``, short texts too."""
    if model is None:
        return {}
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    rows = docs.select(F.struct(lang.alias("lang")).alias("row"), text.alias("text"))
    rows = rows.where("row.lang IS NOT NULL AND octet_length(text) > 0")
    out = arrow_map(rows, _predict_rows(model), f"row struct<lang: string>, {_FOUND}")
    right = store(out.where("row.lang = lang_pred").select("lang_pred", "score"), "scores")
    least = exact_quantiles(right, ["lang_pred"], "score", [share])
    return {r["lang_pred"]: r["q0"] for r in least.collect()}
