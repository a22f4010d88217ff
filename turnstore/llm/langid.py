"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network, written and trained in numpy by backpropagation through time, reads windows of UTF-8 bytes in both
directions and labels every position; a document's probabilities are the mean over all positions of its whole text
that belong to letters. Windows have a fixed length, so memory doesn't depend on the length of texts.

Defined cases: null texts and texts without a letter are `und` with score 0; if no row has a language to learn from,
all are; repeated rows get equal predictions; an empty table gives an empty result; the input's other columns don't
matter: `predict` drops them, `with_language` keeps them as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstore.llm.common import held_out, share_of, unused

#: Most rows that the network learns from, and the length of the stretch of each that goes to the driver. Training reads
#: windows of TRAIN_WINDOW bytes, so a stretch from anywhere in the whole text (its id decides where) serves as well as all.
SAMPLE, SAMPLE_CHARS = 4000, 160
HIDDEN, WINDOW, TRAIN_WINDOW = 8, 128, 64
#: Windows that are read together.
GROUP = 2048
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Bytes that belong to letters: a-z after lowering, and all of multi-byte characters.
IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def run_direction(net: dict, k: int, steps: np.ndarray, cache: list | None = None) -> np.ndarray:
    """Hidden states of windows; steps: bytes by position and window. Gates z, r and the candidate share a table row.

    The table and the recurrent weights of z and r are kept halved, so that a sigmoid is (1 + tanh) / 2.
    """
    x, u = net["x"][k], net["u"][k]
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    out = np.empty((*steps.shape, HIDDEN), np.float32)
    for t, bytes_ in enumerate(steps):
        gx, a = x[bytes_], h @ u
        zr = gx[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = r * a[:, 2 * HIDDEN :]
        n += gx[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if cache is not None:
            cache.append((h, z, r, n, a[:, 2 * HIDDEN :]))
        d = h - n
        d *= z
        h = np.add(n, d, out=out[t])
    return out


def read_direction(net: dict, k: int, steps: np.ndarray, out: np.ndarray) -> None:
    """The same as run_direction for reading only, every array contiguous; out: (HIDDEN, position, window)."""
    cut = [slice(0, HIDDEN), slice(HIDDEN, 2 * HIDDEN), slice(2 * HIDDEN, None)]
    xz, xr, xn = (np.ascontiguousarray(net["x"][k][:, c]) for c in cut)
    uz, ur, un = (np.ascontiguousarray(net["u"][k][:, c]) for c in cut)
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    z, r, n, a = (np.empty_like(h) for _ in range(4))
    for t, bytes_ in enumerate(steps):
        for gate, x, u in ((z, xz, uz), (r, xr, ur)):
            np.matmul(h, u, out=gate)
            gate += x.take(bytes_, 0)
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
        np.matmul(h, un, out=n)
        n *= r
        n += xn.take(bytes_, 0)
        np.tanh(n, out=n)
        np.subtract(h, n, out=a)
        a *= z
        np.add(n, a, out=h)
        out[:, t] = h.T


def read_windows(net: dict, windows: np.ndarray) -> np.ndarray:
    """Probabilities of every position: (language, position, window)."""
    steps = windows.T.astype(np.intp)
    states = np.empty((2 * HIDDEN, *steps.shape), np.float32)
    read_direction(net, 0, steps, states[:HIDDEN])
    read_direction(net, 1, steps[::-1], states[HIDDEN:, ::-1])
    p = (net["w"].T @ states.reshape(2 * HIDDEN, -1)).reshape(-1, *steps.shape)
    p += net["b"][:, None, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def back_direction(net: dict, k: int, steps: np.ndarray, cache: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of the recurrent weights, by backpropagation through time."""
    u = net["u"][k]
    dgx, du = np.empty((*steps.shape, 3 * HIDDEN), np.float32), np.zeros_like(u)
    dh = np.zeros_like(dout[0])
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, n, an = cache[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        g = dgx[t]
        g[:, :HIDDEN] = dh * (h - n) * z * (1 - z) * 2  # twice: the weights are halved
        g[:, HIDDEN : 2 * HIDDEN] = dn * an * r * (1 - r) * 2
        g[:, 2 * HIDDEN :] = dn
        da = g.copy()
        da[:, 2 * HIDDEN :] *= r
        du += h.T @ da
        dh = dh * z + da @ u.T
    flat, order = steps.ravel(), np.argsort(steps.ravel(), kind="stable")
    values, starts = np.unique(flat[order], return_index=True)
    dx = np.zeros_like(net["x"][k])
    dx[values] = np.add.reduceat(dgx.reshape(-1, 3 * HIDDEN)[order], starts)
    return dx, du


def forward(net: dict, windows: np.ndarray, caches: tuple | None = None) -> np.ndarray:
    """States of both directions at every position: (position, window, 2 * HIDDEN)."""
    steps = np.ascontiguousarray(windows.T)
    ahead = run_direction(net, 0, steps, caches and caches[0])
    back = run_direction(net, 1, steps[::-1], caches and caches[1])[::-1]
    return np.concatenate((ahead, back), axis=2)


def probabilities(net: dict, states: np.ndarray) -> np.ndarray:
    logits = states.reshape(-1, 2 * HIDDEN) @ net["w"] + net["b"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def train(texts: list[str], langs: list[str], steps: int = 350, batch: int = 128, seed: int = 11) -> dict:
    """A network that tells the languages apart; every learned-from language counts as much as any other."""
    names = sorted(set(langs))
    rng, n, f = np.random.default_rng(seed), len(names), np.float32
    net = {
        "x": [rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(f) for _ in range(2)],
        "u": [rng.normal(0, 0.5 / HIDDEN**0.5, (HIDDEN, 3 * HIDDEN)).astype(f) for _ in range(2)],
        "w": rng.normal(0, 0.3, (2 * HIDDEN, n)).astype(f),
        "b": np.zeros(n, f),
    }
    data = [t.lower().encode("utf-8") for t in texts]
    groups = [np.array([k for k, x in enumerate(langs) if x == name]) for name in names]
    flat = [*net["x"], *net["u"], net["w"], net["b"]]
    m1, m2 = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    for step in range(1, steps + 1):
        y = rng.integers(0, n, batch)
        windows = np.zeros((batch, TRAIN_WINDOW), np.uint8)
        for row, cls in enumerate(y):
            text = data[rng.choice(groups[cls])]
            size = int(rng.integers(8, TRAIN_WINDOW + 1))
            at = int(rng.integers(0, max(1, len(text) - size + 1)))
            piece = text[at : at + size]
            windows[row, : len(piece)] = np.frombuffer(piece, np.uint8)
        caches = ([], [])
        states = forward(net, windows, caches)
        p = probabilities(net, states)
        on = IS_LETTER[windows.T].reshape(-1)
        p[np.arange(len(p)), np.tile(y, TRAIN_WINDOW)] -= 1
        p *= (on / max(1, on.sum()))[:, None].astype(f)
        ds = (p @ net["w"].T).reshape(states.shape)
        dx0, du0 = back_direction(net, 0, np.ascontiguousarray(windows.T), caches[0], ds[:, :, :HIDDEN])
        dx1, du1 = back_direction(net, 1, np.ascontiguousarray(windows.T)[::-1], caches[1], ds[::-1, :, HIDDEN:])
        grads = [dx0, dx1, du0, du1, states.reshape(-1, 2 * HIDDEN).T @ p, p.sum(0)]
        norm = max(1.0, float(np.sqrt(sum((g.astype(float) ** 2).sum() for g in grads))))
        rate = 0.03 * min(1.0, 3 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(flat, grads, m1, m2):
            g = g / norm
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(f)
    return net | {"names": names}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """Learn from rows outside the held-out fold, the SAMPLE of least hash if there are more; None without any."""
    place = 1 + F.pmod(F.xxhash64(id_col, F.lit("place")), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(1)))
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.where(share_of(F.xxhash64(id_col, F.lit("share")), SAMPLE, known.count())).select(
        F.xxhash64(id_col).alias("h"), F.substring(F.col(text_col), place.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), F.col(lang_col).alias("l")
    )
    rows = rows.where(F.col("t").rlike(r"\p{L}")).orderBy("h", "t", "l").limit(SAMPLE).collect()
    return train([r["t"] for r in rows], [r["l"] for r in rows]) if rows else None


def read_texts(net: dict, texts: Iterable[str]) -> np.ndarray:
    """The pooled probabilities of texts; each text's windows follow one another, the last one padded with zeros."""
    sums, counts = [], []
    pending: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        of = np.concatenate([np.full(len(w), k) for k, w in pending])
        windows = np.concatenate([w for _, w in pending])
        pending.clear()
        held = 0
        on = IS_LETTER[windows.T]
        p = read_windows(net, windows)
        p *= on
        first, last = int(of[0]), int(of[-1]) + 1
        summed, counted = np.zeros((last - first, len(net["names"]))), np.zeros(last - first)
        np.add.at(summed, of - first, p.sum(1).T)
        np.add.at(counted, of - first, on.sum(0))
        for k in range(first, last):
            sums[k] += summed[k - first]
            counts[k] += counted[k - first]

    for k, text in enumerate(texts):
        data = text.lower().encode("utf-8")
        sums.append(np.zeros(len(net["names"])))
        counts.append(0.0)
        for at in range(0, len(data), WINDOW * GROUP):
            part = data[at : at + WINDOW * GROUP]
            windows = np.frombuffer(part + bytes(-len(part) % WINDOW), np.uint8).reshape(-1, WINDOW)
            pending.append((k, windows))
            held += len(windows)
            if held >= GROUP:
                flush()
    flush()
    return np.array(sums).reshape(len(sums), -1) / np.maximum(counts, 1)[:, None]


def with_language(docs: DataFrame, net: dict | None, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows with a struct of lang_pred and score of every whole text, and that column's name; narrow, no shuffle."""

    @F.arrow_udf("struct<lang_pred string, score double>")
    def labelled(texts: pa.Array) -> pa.Array:
        # one text of the batch at a time is a Python string
        known = [k for k, t in enumerate(texts) if net and t.is_valid and LETTER.search(t.as_py())]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = read_texts(net, (texts[k].as_py() for k in known))
            for k, best, s in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
                langs[k], scores[k] = net["names"][best], s
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    (name,) = unused(docs, "labelled")
    return docs.withColumn(name, labelled(F.col(text_col))), name


def predict(docs: DataFrame, net: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every whole text."""
    found, name = with_language(docs.select(id_col, text_col), net, text_col)
    return found.select(id_col, F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))
