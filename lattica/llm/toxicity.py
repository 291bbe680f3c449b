"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import batches, joined_bytes, read, tuned
from lattica.llm.rolling import Hashes

#: Words in a window, and from one window's start to the next: every word but a text's first and last few is in two.
WINDOW, STRIDE = 32, 16
#: Hash buckets of words and of word starts, size of their vectors, and of the state in each direction.
BUCKETS, SIZE, STATE = 1 << 16, 8, 8
#: Lengths of the word starts that have vectors of their own, beside the word and its characters.
PREFIXES = (3, 4, 5, 6)
#: Bytes of a word that the character network reads; a longer run of letters counts as several words.
SPELLED = 32
#: The bounded sample the network is fitted on: texts of either label, bytes of a text, and bytes of all texts of a label;
#: windows of a clean text that a pass looks at, chosen anew each time; then least numbers of passes over it and of steps.
SAMPLE = {1: 900, 0: 1800}
SAMPLE_TEXT, SAMPLE_BYTES, SAMPLE_WINDOWS = 1 << 16, 8 << 20, 24
PASSES, STEPS = 6, 180

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Kinds:
    """The distinct words of some texts: hashed features [kind, 1 + len(PREFIXES)], bytes [kind, SPELLED] and their number."""

    features: np.ndarray
    spelling: np.ndarray
    length: np.ndarray

    def __len__(self) -> int:
        return len(self.features)

    def of(self, which: np.ndarray) -> Kinds:
        return Kinds(self.features[which], self.spelling[which], self.length[which])


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, Kinds]:
    """Of joined texts: the first word of each text (n + 1), each word's kind, and the kinds.

    A word is a run of letters, digits and bytes beyond ASCII, in lower case. Features: a bucket of the word and one of
    each of its starts; its bytes are read in order by the character network.
    """
    none = Kinds(np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros((0, SPELLED), np.uint8), np.zeros(0, np.int64))
    if not len(data):
        return np.zeros(len(at), np.int64), np.zeros(0, np.int64), none
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    parts = -(-(end - start) // SPELLED)
    if (parts > 1).any():
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, stop = np.repeat(start, parts) + k * SPELLED, np.repeat(end, parts)
        end = np.minimum(start + SPELLED, stop)
    if not len(start):
        return np.searchsorted(start, at), np.zeros(0, np.int64), none
    hashes = Hashes(data)
    _, first, kind = np.unique(hashes.of(start, end), return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    whole = hashes.of(s, e)
    columns = [whole] + [np.where(e - s > n, hashes.of(s, np.minimum(s + n, e)) + np.uint64(n), whole ^ np.uint64(0x5DEECE66D * n)) for n in PREFIXES]
    features = np.stack([(c >> np.uint64(20)) % np.uint64(BUCKETS) for c in columns], axis=1).astype(np.int64)
    spelling = np.concatenate([data, np.zeros(SPELLED, np.uint8)])[s[:, None] + np.arange(SPELLED)]
    return np.searchsorted(start, at), kind, Kinds(features, spelling, e - s)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; a text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[text] + k * STRIDE, np.minimum(WINDOW, n[text] - k * STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights: word and start vectors, a recurrent layer over a word's characters, two over the words of a window (gates:
    update, reset, new), attention, output."""

    word: np.ndarray
    chars: np.ndarray
    spell: dict[str, np.ndarray]
    layers: list[dict[str, np.ndarray]]
    attention: np.ndarray
    focus: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    tables: list | None = field(default=None, repr=False)

    @classmethod
    def new(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        layers = [{"x": np.concatenate([mat(2 * SIZE, 3 * STATE), mat(STATE, 3 * STATE)]), "h": mat(STATE, 3 * STATE), "b": np.zeros(3 * STATE, np.float32)} for _ in range(2)]
        spell = {"x": (rng.standard_normal((256, 3 * STATE)) / 2).astype(np.float32), "h": mat(STATE, 3 * STATE)}
        return cls(np.zeros((BUCKETS, SIZE), np.float32), np.zeros((BUCKETS, SIZE), np.float32), spell, layers, mat(2 * STATE, STATE), mat(STATE, 1)[:, 0], mat(2 * STATE, 1)[:, 0], np.full(1, -2, np.float32))

    def spelled(self, kinds: Kinds, keep: bool = False):
        """The state of the character layer after each word's last character. keep: also what the gradient needs."""
        order = np.argsort(-kinds.length, kind="stable")
        letters, n, s = kinds.spelling[order], kinds.length[order], STATE
        h, kept = np.zeros((len(order), s), np.float32), []
        for t in range(int(n.max(initial=0))):
            m = int(np.searchsorted(-n, -t, side="left"))  # words of more than t characters
            x, u, old = self.spell["x"][letters[:m, t]], h[:m] @ self.spell["h"], h[:m].copy()
            zr = sigmoid(x[:, : 2 * s] + u[:, : 2 * s])
            z, r = zr[:, :s], zr[:, s:]
            new = np.tanh(x[:, 2 * s :] + r * u[:, 2 * s :])
            h[:m] = new + z * (old - new)
            if keep:
                kept.append((letters[:m, t], old, z, r, new, u[:, 2 * s :]))
        out = np.empty_like(h)
        out[order] = h
        return (out, order, kept) if keep else out

    def gates(self, kinds: Kinds) -> np.ndarray:
        """What each kind of word adds to the gates of both directions: [kind, 6 * STATE]."""
        if self.tables is None:
            self.tables = [np.concatenate([v @ la["x"][p : p + SIZE] for la in self.layers], axis=1) for v, p in ((self.word, 0), (self.chars, SIZE))]
        g = self.tables[0][kinds.features[:, 0]]
        for j in range(1, kinds.features.shape[1]):
            g = g + self.tables[1][kinds.features[:, j]]
        g = g + self.spelled(kinds) @ np.concatenate([la["x"][2 * SIZE :] for la in self.layers], axis=1)
        return (g + np.concatenate([la["b"] for la in self.layers])).astype(np.float32)

    def logits(self, gates: np.ndarray, kind: np.ndarray, start: np.ndarray, n: np.ndarray, keep: bool = False):
        """Of each window; gates: of each kind of word. keep: also what the gradient needs."""
        steps, b, s = int(max(1, n.max(initial=1))), len(start), STATE
        have = np.arange(steps)[:, None] < n[None, :]
        at = np.where(have, start[None, :] + np.arange(steps)[:, None], 0)
        kinds = kind[at] if len(kind) else np.zeros_like(at)
        states = np.zeros((steps, b, 2 * s), np.float32)
        kept = []
        for d in range(2):
            h = np.zeros((b, s), np.float32)
            w = self.layers[d]["h"]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = gates[kinds[t], 3 * s * d : 3 * s * (d + 1)] if len(gates) else np.zeros((b, 3 * s), np.float32)
                u = h @ w
                zr = sigmoid(x[:, : 2 * s] + u[:, : 2 * s])
                z, r = zr[:, :s], zr[:, s:]
                new = np.tanh(x[:, 2 * s :] + r * u[:, 2 * s :])
                m = have[t][:, None]
                if keep:
                    kept.append((d, t, h, z, r, new, u[:, 2 * s :]))
                h = np.where(m, new + z * (h - new), h)
                states[t, :, s * d : s * (d + 1)] = h
        u = np.tanh(states @ self.attention)
        e = np.where(have, u @ self.focus, -1e9)
        a = np.exp(e - e.max(axis=0)) * have
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbs->bs", a, states)
        y = pooled @ self.out + self.bias[0]
        return (y, states, u, a, pooled, have, kinds, kept) if keep else y

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The greatest score of each text's windows."""
        data, at = joined_bytes(texts)
        first, kind, distinct = words(data, at)
        text, start, n = windows(first)
        gates = self.gates(distinct)
        order = np.argsort(-n, kind="stable")  # windows that are not full go together
        y = np.empty(len(start), np.float64)
        for i in range(0, len(order), 2048):
            part = order[i : i + 2048]
            y[part] = self.logits(gates, kind, start[part], n[part])
        return sigmoid(np.maximum.reduceat(y, np.searchsorted(text, np.arange(len(at) - 1)))) if len(at) > 1 else y

    def step(self, distinct: Kinds, kind: np.ndarray, start: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> float:
        """One step of gradient descent on the windows' cross-entropy."""
        self.tables = None
        s = STATE
        used = np.unique(kind[np.concatenate([np.arange(a, a + m) for a, m in zip(start, n, strict=True)])]) if n.sum() else np.zeros(0, np.int64)
        own = distinct.of(used)
        f = own.features
        spelt, by_length, spelling = self.spelled(own, keep=True)
        x = np.concatenate([self.word[f[:, 0]], self.chars[f[:, 1:]].sum(axis=1), spelt], axis=1)
        g = np.concatenate([x @ la["x"] + la["b"] for la in self.layers], axis=1)
        local = np.zeros(len(distinct), np.int64)
        local[used] = np.arange(len(used))
        logit, states, u, a, pooled, have, kinds, kept = self.logits(g, local[kind], start, n, keep=True)
        p = sigmoid(logit)
        dy = ((p - y) * weight / weight.sum()).astype(np.float32)
        grads = {"out": pooled.T @ dy, "bias": dy.sum(keepdims=True)}
        dp = dy[:, None] * self.out
        da = np.einsum("bs,tbs->tb", dp, states)
        ds = a[:, :, None] * dp[None]
        de = a * (da - (a * da).sum(axis=0))
        grads["focus"] = np.einsum("tb,tbs->s", de, u)
        du = de[:, :, None] * self.focus * (1 - u * u)
        grads["attention"] = np.einsum("tbi,tbj->ij", states, du)
        ds += du @ self.attention.T
        dx = np.zeros((len(used), 2 * SIZE + STATE), np.float32)
        for d in range(2):
            la = self.layers[d]
            gx, gh, gb = np.zeros_like(la["x"]), np.zeros_like(la["h"]), np.zeros_like(la["b"])
            dg = np.zeros((len(used), 3 * s), np.float32)
            dh = np.zeros((len(start), s), np.float32)
            for _, t, h, z, r, new, hn in reversed([k for k in kept if k[0] == d]):
                dh = dh + ds[t, :, s * d : s * (d + 1)]
                m = have[t][:, None]
                now = np.where(m, dh, 0)
                dn = now * (1 - z) * (1 - new * new)
                dz = now * (h - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                back = np.concatenate([dz, dr, dn * r], axis=1)
                gh += h.T @ back
                gates_ = np.concatenate([dz, dr, dn], axis=1)
                gb += gates_.sum(axis=0)
                np.add.at(dg, kinds[t][have[t]], gates_[have[t]])
                dh = np.where(m, now * z + back @ la["h"].T, dh)
            gx += x.T @ dg
            dx += dg @ la["x"].T
            grads[f"x{d}"], grads[f"h{d}"], grads[f"b{d}"] = gx, gh, gb
        ex, eh = np.zeros_like(self.spell["x"]), np.zeros_like(self.spell["h"])
        dh = dx[by_length, 2 * SIZE :]
        for letters, h, z, r, new, hn in reversed(spelling):
            now = dh[: len(letters)].copy()
            dn = now * (1 - z) * (1 - new * new)
            dz = now * (h - new) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            back = np.concatenate([dz, dr, dn * r], axis=1)
            eh += h.T @ back
            np.add.at(ex, letters, np.concatenate([dz, dr, dn], axis=1))
            dh[: len(letters)] = now * z + back @ self.spell["h"].T
        grads["spell-x"], grads["spell-h"] = ex, eh
        for name, v in (("spell-x", self.spell["x"]), ("spell-h", self.spell["h"]), ("out", self.out), ("bias", self.bias), ("focus", self.focus), ("attention", self.attention), *((f"{k}{d}", self.layers[d][k]) for d in range(2) for k in "xhb")):
            gr = grads[name]
            m, q, i = state.get(name, (0, 0, 0))
            m, q, i = 0.9 * m + 0.1 * gr, 0.99 * q + 0.01 * gr * gr, i + 1
            state[name] = m, q, i
            v -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(q / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
        for name, table, rows, gr in (("word", self.word, f[:, 0], dx[:, :SIZE]), *(("chars", self.chars, f[:, j], dx[:, SIZE : 2 * SIZE]) for j in range(1, f.shape[1]))):
            r, back = np.unique(rows, return_inverse=True)
            total = np.zeros((len(r), SIZE), np.float32)
            np.add.at(total, back, gr)
            q = state.setdefault(name, np.zeros(len(table), np.float32))
            q[r] += (total * total).sum(axis=1)
            table[r] -= 10 * rate * total / (np.sqrt(q[r]) + 1e-4)[:, None]
        return float(np.mean(np.where(y == 1, -np.log(p + 1e-9), -np.log(1 - p + 1e-9))))


def fit(texts: list[str], labels: list[int], seed: int = 1) -> Network:
    """A network that gives a toxic text a window with a high score, and a clean text none.

    Each pass scores all windows of toxic texts and SAMPLE_WINDOWS of each clean one, and learns from some of every text:
    of clean ones the two highest and a few at random, of toxic ones the highest (in the first passes, the four highest).
    Without texts of both labels, scores stay those of a new network: low.
    """
    net, rng = Network.new(seed), np.random.default_rng(seed)
    if len(set(labels)) < 2:
        return net
    data, at = joined_bytes(pa.array(texts, pa.string()))
    first, kind, distinct = words(data, at)
    text, start, n = windows(first)
    y = np.array(labels)
    begin = np.searchsorted(text, np.arange(len(y) + 1))

    def logits(which: np.ndarray) -> np.ndarray:
        gates = net.gates(distinct)
        return np.concatenate([net.logits(gates, kind, start[w], n[w]) for w in np.split(which, range(2048, len(which), 2048))])

    state: dict = {}
    passes, k, steps = PASSES, -1, 0
    while (k := k + 1) < passes:
        mixed = np.lexsort([rng.random(len(start)), text])
        few = mixed[(y[text[mixed]] == 1) | (np.arange(len(mixed)) - begin[text[mixed]] < SAMPLE_WINDOWS)]
        by = few[np.lexsort([-logits(few), text[few]])]
        rank = np.arange(len(by)) - np.searchsorted(text[by], text[by])
        take = np.where(y[text[by]] == 1, rank < (4 if 3 * k < passes else 1), rank < 2)
        chosen = np.unique(np.concatenate([by[take], few[(y[text[few]] == 0) & (rng.random(len(few)) < 0.08)]]))
        chosen = rng.permutation(chosen)
        weight = np.where(y[text] == 1, max(1.0, (y[text[chosen]] == 0).sum() / max(1, (y[text[chosen]] == 1).sum()) / 2), 1.0)
        for i in range(0, len(chosen), 128):
            c = chosen[i : i + 128]
            net.step(distinct, kind, start[c], n[c], y[text[c]], weight[c], state, 0.01 if 3 * k < 2 * passes else 0.003)
            steps += 1
        if k == 0:  # few texts are seen more often
            passes = max(PASSES, min(60, -(-STEPS // max(1, steps))))
    net.tables = None
    # The cut lies between the highest scores of clean texts and the lowest of toxic ones, nearer to these: a text of many
    # windows that were not learnt from has more chances of a high one.
    top = np.maximum.reduceat(logits(np.arange(len(start))), begin[:-1])
    net.bias -= np.float32(0.3 * np.quantile(top[y == 0], 0.998) + 0.7 * np.quantile(top[y == 1], 0.005))
    net.tables = None
    return net


def held_out() -> F.Column:
    """Rows that are never learnt from: CRC-32 of the id's decimal digits is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample of labelled rows that are not held out, chosen by a hash of the id.

    Of each label at most SAMPLE texts, of SAMPLE_TEXT bytes at most, and SAMPLE_BYTES in all. Ids are chosen among the
    labels alone, twice as many as are used, as some may have no text; so many ids, whatever the corpus, are broadcast.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "toxic").distinct()
    ids = [known.where(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64("doc_id").alias("o")).orderBy("o", "doc_id").limit(2 * most) for y, most in SAMPLE.items()]
    ids = ids[0].unionByName(ids[1])
    size = F.octet_length("text")
    found = docs.where("text IS NOT NULL").where(size <= SAMPLE_TEXT).select("doc_id", "text", size.alias("bytes")).join(F.broadcast(ids), "doc_id")
    w = Window.partitionBy("toxic").orderBy("o", "doc_id", F.xxhash64("text"))
    most = F.when(F.col("toxic") == 1, SAMPLE[1]).otherwise(SAMPLE[0])
    found = found.withColumn("rank", F.row_number().over(w)).withColumn("sum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return found.where((F.col("rank") <= most) & (F.col("sum") <= SAMPLE_BYTES)).select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted on the sample, in one task: only its weights, of a fixed size, come to the driver."""

    def learn(it) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[2], r[0], r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["net"])

    return pickle.loads(sample(docs, labels).repartition(1).mapInArrow(learn, "net binary").first()[0])


def scored(docs: DataFrame, net: Network, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with a score, the greatest of all overlapping windows of the whole text, and a prediction, the score cut at 0.5.

    Null and empty texts have one empty window, whose score is that of no words at all. Rows, repeated or not, and columns
    stay; columns that have the two given names are replaced.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(net)  # a few MB, whatever the corpus

    @F.pandas_udf("double")
    def value(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        net = given.value
        column = pa.array(texts, pa.string(), from_pandas=True)
        parts = [net.scores(b.column(0)) for b in batches([pa.RecordBatch.from_arrays([column], names=["t"])], size=1 << 19)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0), dtype="float64")

    return docs.withColumn(score, value("text")).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, from a network trained on those that are not held out.

    A row for each row of documents; null and empty texts have the score of no words. A null id is not held out. Without
    labels of both kinds all scores are those of a new network, below one half.
    """
    tuned(spark)
    docs = read(spark, sf_dir, "documents")
    net = train(docs, read(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
