"""Language identification by a bidirectional gated recurrent network over bytes.

A small GRU reads the bytes of a text in both directions and gives every position class
probabilities; a document's probabilities are the mean over the positions of its letters.
The network is trained here, in numpy, by backpropagation through time on segments drawn
from everywhere in the texts of a bounded sample of labelled rows (``TRAIN_ROWS``, a
parameter): as many segments as training reads, so the driver holds those and no texts.

Prediction reads whole texts. They are cut into segments of ``SEGMENT`` bytes with
``MARGIN`` bytes of context on either side that warm the states and are not labelled, and
segments of many documents run side by side, so memory is bounded by ``LANES`` segments,
whatever a text's length. There is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import broadcast_if_small, durable, map_batches

HIDDEN = 8
SEGMENT = 112
MARGIN = 8
LANES = 2048
TRAIN_ROWS = 2400
STEPS = 420
BATCH = 192
UNKNOWN = "und"


def held_out(doc_id):
    """Rows that no model may learn from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _squash(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0.0, 1.0, out=x)


class Model:
    """Weights: for each direction byte tables E (256 x 3H), recurrent U (H x 3H), then a
    layer V (2H x classes) on both directions' states. Gates: update, reset, candidate."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h, c = hidden, len(labels)
        f = np.float32
        self.w = {
            "E0": rng.normal(0, 0.5, (256, 3 * h)).astype(f),
            "E1": rng.normal(0, 0.5, (256, 3 * h)).astype(f),
            "U0": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f),
            "U1": rng.normal(0, h**-0.5, (h, 3 * h)).astype(f),
            "V": rng.normal(0, 0.3, (2 * h, c)).astype(f),
            "b": np.zeros(c, f),
        }

    def states(self, table: np.ndarray, u: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Hidden states (time, lane, H) of one direction; steps: bytes (time, lane)."""
        h = self.hidden
        times, lanes = steps.shape
        out = np.empty((times, lanes, h), np.float32)
        state = np.zeros((lanes, h), np.float32)
        gates, candidate = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        x = np.empty((lanes, 3 * h), np.float32)
        z = np.empty((lanes, 2 * h), np.float32)
        for t in range(times):
            np.take(table, steps[t], axis=0, out=x)
            np.matmul(state, gates, out=z)
            z += x[:, : 2 * h]
            _squash(z)
            n = (z[:, h:] * state) @ candidate
            n += x[:, 2 * h :]
            np.clip(n, -1.0, 1.0, out=n)
            n -= state
            n *= z[:, :h]
            state = np.add(state, n, out=out[t])
        return out

    def probabilities(self, steps: np.ndarray) -> np.ndarray:
        """(time, lane, class) probabilities of every position."""
        w = self.w
        forward = self.states(w["E0"], w["U0"], steps)
        backward = self.states(w["E1"], w["U1"], steps[::-1])[::-1]
        h = self.hidden
        score = forward @ w["V"][:h]
        score += backward @ w["V"][h:]
        score += w["b"]
        score -= score.max(axis=2, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=2, keepdims=True)
        return score

    # training

    def _forward(self, side: int, steps: np.ndarray) -> tuple:
        h = self.hidden
        e, u = self.w[f"E{side}"], self.w[f"U{side}"]
        state = np.zeros((steps.shape[1], h), np.float32)
        kept = []
        for row in steps:
            x = e[row]
            a = x[:, : 2 * h] + state @ u[:, : 2 * h]
            g = np.clip(a * 0.25 + 0.5, 0, 1)
            z, r = g[:, :h], g[:, h:]
            q = x[:, 2 * h :] + (r * state) @ u[:, 2 * h :]
            n = np.clip(q, -1, 1)
            new = state + z * (n - state)
            kept.append((row, state, a, z, r, q, n))
            state = new
        return kept, np.stack([*[k[1] for k in kept[1:]], state])

    def _backward(self, side: int, kept: list, upper: np.ndarray, grads: dict) -> None:
        h = self.hidden
        u = self.w[f"U{side}"]
        de, du = grads[f"E{side}"], grads[f"U{side}"]
        later = np.zeros_like(upper[0])
        for (row, state, a, z, r, q, n), above in zip(reversed(kept), upper[::-1], strict=True):
            d = above + later
            dn = d * z * (np.abs(q) < 1)
            drs = dn @ u[:, 2 * h :].T
            dg = np.concatenate([d * (n - state), drs * state], axis=1) * 0.25 * (np.abs(a) < 2)
            later = d * (1 - z) + drs * r + dg @ u[:, : 2 * h].T
            du[:, : 2 * h] += state.T @ dg
            du[:, 2 * h :] += (r * state).T @ dn
            np.add.at(de, row, np.concatenate([dg, dn], axis=1))

    def train_step(self, steps: np.ndarray, target: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Mean loss over real positions, and gradients. target: class of each lane."""
        h = self.hidden
        v = self.w["V"]
        kept0, s0 = self._forward(0, steps)
        kept1, s1 = self._forward(1, steps[::-1])
        both = np.concatenate([s0, s1[::-1]], axis=2)
        score = both @ v + self.w["b"]
        score -= score.max(axis=2, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=2, keepdims=True)
        lanes = np.arange(len(target))
        weight = real.astype(np.float32) / max(real.sum(), 1)
        loss = float(-(np.log(p[:, lanes, target] + 1e-9) * weight).sum())
        p[:, lanes, target] -= 1
        p *= weight[:, :, None]
        grads = {k: np.zeros_like(x) for k, x in self.w.items()}
        grads["V"] = np.einsum("tlh,tlc->hc", both, p, optimize=True)
        grads["b"] = p.sum(axis=(0, 1))
        upper = p @ v.T
        self._backward(0, kept0, upper[:, :, :h], grads)
        self._backward(1, kept1, upper[::-1, :, h:], grads)
        return loss, grads


def train(segments: list[str], langs: list[str], steps: int = STEPS, seed: int = 11) -> Model:
    """Adam on labelled segments, of which the first ``SEGMENT`` bytes are read; languages are
    drawn equally often, and of one language all segments before any is drawn again."""
    labels = sorted(set(langs))
    model = Model(labels)
    rng = np.random.default_rng(seed)
    by = [[t.encode()[:SEGMENT] for t, lang in zip(segments, langs, strict=True) if lang == x and t.strip()] for x in labels]
    for own in by:
        rng.shuffle(own)
    drawn = [0] * len(labels)
    usable = [k for k, own in enumerate(by) if own]
    if not usable:
        return model
    mean = {k: np.zeros_like(x) for k, x in model.w.items()}
    square = {k: np.zeros_like(x) for k, x in model.w.items()}
    for step in range(1, steps + 1):
        lanes, target = np.full((SEGMENT, BATCH), 32, np.uint8), np.zeros(BATCH, np.int64)
        real = np.zeros((SEGMENT, BATCH), bool)
        for lane in range(BATCH):
            k = usable[lane % len(usable)]
            part = np.frombuffer(by[k][drawn[k] % len(by[k])], np.uint8)
            drawn[k] += 1
            lanes[: len(part), lane], target[lane] = part, k
            real[: len(part), lane] = LETTER[part]
        _, grads = model.train_step(lanes, target, real)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, g in grads.items():
            mean[name] += 0.1 * (g - mean[name])
            square[name] += 0.01 * (g * g - square[name])
            unbiased = mean[name] / (1 - 0.9**step)
            model.w[name] -= rate * unbiased / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-6)
    return model


#: Bytes that can be part of a letter.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def _label_segments(model: Model, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Sums of class probabilities over the letter positions of each segment.

    ``starts``: first byte of each segment's own part; ``begin`` and ``end``: bounds of its
    document, beyond which is blank."""
    width = SEGMENT + 2 * MARGIN
    sums = np.zeros((len(starts), len(model.labels)))
    count = np.zeros(len(starts), np.int64)
    offset = np.arange(-MARGIN, SEGMENT + MARGIN)[:, None]
    padded = np.concatenate([np.full(MARGIN, 32, np.uint8), data, np.full(width, 32, np.uint8)])
    for lo in range(0, len(starts), LANES):
        part = slice(lo, lo + LANES)
        at = offset + starts[part]
        steps = np.where((at >= begin[part]) & (at < end[part]), padded[at + MARGIN], 32).astype(np.uint8)
        p = model.probabilities(steps)[MARGIN : MARGIN + SEGMENT]
        real = LETTER[steps[MARGIN : MARGIN + SEGMENT]]
        sums[part] = np.einsum("tlc,tl->lc", p, real.astype(np.float32), optimize=True)
        count[part] = real.sum(axis=0)
    return sums, count


def label_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of each text; ``und`` without letters."""
    from .textnum import slices

    labels: list[str] = []
    scores: list[float] = []
    lettered = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_pylist()
    for lo, hi, data, offsets in slices(texts):
        size = np.diff(offsets)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(hi - lo), pieces)
        first = np.cumsum(pieces) - pieces
        starts = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        sums, count = _label_segments(model, data, starts, offsets[:-1][owner], offsets[1:][owner])
        total = np.zeros((hi - lo, len(model.labels)))
        np.add.at(total, owner, sums)
        letters = np.bincount(owner, count, hi - lo)
        for i in range(hi - lo):
            if letters[i] and lettered[lo + i]:
                best = int(np.argmax(total[i]))
                labels.append(model.labels[best])
                scores.append(float(min(1.0, total[i, best] / letters[i])))
            else:
                labels.append(UNKNOWN)
                scores.append(0.0)
    return labels, np.array(scores)


def _predicted(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, scores = label_texts(model, batch.column(2))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, steps: int = STEPS) -> Model | None:
    """Train on at most ``rows`` rows that are not held out, as many of each language at most,
    chosen by a hash of doc_id, so that every language is learnt up to ``rows`` of them. Of
    each as many segments are drawn, at hashed places of its whole text, as make up all that
    training reads; they alone come to the driver. None without labelled rows."""
    usable = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    hashed = F.xxhash64("doc_id")
    # hashes first, so that texts of the chosen rows alone are moved: rows are counted by the
    # hash's high bits, and of each language the first cells that hold its share are read
    cell = F.shiftright(hashed, 52).alias("cell")
    cells = durable(usable.groupBy("lang", cell).agg(F.count("*").alias("n")))
    languages = cells.select("lang").distinct().count()
    if not languages:
        return None
    share = max(1, rows // languages)
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    first = cells.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < share).select("lang", "cell")
    chosen = usable.withColumn("cell", cell).join(broadcast_if_small(durable(first)), ["lang", "cell"], "left_semi")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t")).alias("place")
    listed = chosen.select(hashed.alias("h"), F.xxhash64("text").alias("t"), "lang", "text")
    ranked = durable(listed.select("h", "t", "lang").select("*", place).where(F.col("place") <= share))
    some = ranked.orderBy("place", "h", "t").limit(rows).agg(F.count("*")).first()[0]
    per_row = -(-steps * BATCH // max(some, 1))
    spare = F.greatest(F.length("text") - SEGMENT, F.lit(0)) + 1
    at = lambda i: F.pmod(F.xxhash64("h", "t", i), spare.cast("long")).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(per_row)), lambda i: F.substring(F.col("text"), at(i), F.lit(SEGMENT)))
    least = F.broadcast(ranked.orderBy("place", "h", "t").limit(rows).select("h", "t", "lang").distinct())
    drawn = listed.join(least, ["h", "t", "lang"], "left_semi").dropDuplicates(["h", "t", "lang"]).select("h", "t", "lang", cut.alias("segments")).collect()
    drawn = sorted(drawn, key=lambda r: (r["h"], r["t"]))
    pairs = [(x, r["lang"]) for r in drawn for x in r["segments"]]
    return train([x for x, _ in pairs], [lang for _, lang in pairs], steps)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    Null texts and texts without letters are ``und`` with score 0, as is every row if no
    labelled row can be learnt from; a null doc_id is kept as null and counts as an empty
    one for ``held_out``; repeated rows are predicted alike; an empty table gives no rows."""
    model = model or fit(docs)
    narrow = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"),
        docs["text"].alias("text"),
    )
    if model is None:
        return narrow.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return map_batches(
        narrow, lambda it: _predicted(it, model), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
