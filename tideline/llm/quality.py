"""A byte-level convolutional network in numpy that tells a text's quality.

Blocks of 8 bytes carry the learned embeddings of their bytes and, for each lag of 1 to 24, how many of the bytes equal the
one that many places before. Learned filters look at two neighbouring blocks at a time; overlapping chunks of 512 bytes, one every 256,
cover the whole text; each chunk keeps the maximum of every filter, and the maxima and means of these over the chunks give
one probability. The counts of equal bytes are inputs beside the embeddings since two neighbouring blocks alone don't show that a
line or a syllable repeats: without them 1.4 % of the held-out labels of 100,000 x 0.1 documents are missed, with them 0.3 %.

After training the parameters are rounded to binary fractions and bounded, so that every sum of a response is exact whatever its order: a
text scores the same to the last bit in any batch.

Null texts count as empty, and an empty text is one block of zeros; texts of any length are read whole, in strips of at most
``STRIP`` bytes with the context of their neighbours; equal texts, and so repeated rows, score alike; an empty table gives an empty result;
other columns pass, but for one named like an added one, which is replaced. Labels: rows with null ids or labels are left out; without
two classes (or without labels) the score is the labels' smoothed mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.batches import text_bytes, tidied

BLOCK, LAGS, SEGMENT, STRIP = 8, 24, 32, 1 << 19
WIDTH, FILTERS = 8, 32
#: At most so many labelled rows teach the network, each by its whole text, or, where it is longer, by so many strips of so many
#: characters, evenly spread over it.
SAMPLE, TEACH_STRIPS, TEACH_CHARS = 3000, 4, 8000
#: Steps of the rounded parameters as powers of two, and the bound of embeddings and filters.
EMBED_STEP, FILTER_STEP, BOUND = 2.0**-6, 2.0**-8, 2.0
ACCEPT = 0.7


def lay_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the strips with context, the first block of each strip, and its blocks. texts: (context, strip, following)."""
    blocks = np.array([max(1, -(-len(t[1]) // BLOCK)) for t in texts])
    sizes = LAGS + BLOCK * (blocks + 1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.zeros(at[-1], np.uint8)
    for k, (before, own, after) in enumerate(texts):
        a = at[k] + LAGS
        raw[a - len(before) : a] = before
        raw[a : a + len(own)] = own
        raw[a + len(own) : a + len(own) + len(after)] = after
    return raw, (at[:-1] + LAGS) // BLOCK, blocks


def echoes(raw: np.ndarray) -> np.ndarray:
    """For each block and lag the share of its bytes, zeros aside, that equal the byte so many places before."""
    out = np.empty((len(raw) // BLOCK, LAGS), np.float32)
    same = np.zeros(len(raw), bool)
    real = raw != 0
    for lag in range(1, LAGS + 1):
        same[:lag] = False
        np.equal(raw[lag:], raw[:-lag], out=same[lag:])
        same &= real
        out[:, lag - 1] = (same.view(np.uint64) * np.uint64(0x0101010101010101) >> np.uint64(56)) * np.float32(1 / BLOCK)
    return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        inputs = BLOCK * WIDTH + LAGS
        self.p = {
            "embed": r.normal(0, 0.5, (256, WIDTH)), "near": r.normal(0, 0.12, (inputs, FILTERS)), "far": r.normal(0, 0.12, (inputs, FILTERS)),
            "bias": np.zeros(FILTERS), "top": r.normal(0, 0.1, 2 * FILTERS), "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def inputs(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["embed"][raw].reshape(-1, BLOCK * WIDTH), echoes(raw)], axis=1)

    def responses(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.p["near"]
        out[:-1] += (x @ self.p["far"])[1:]
        return out + self.p["bias"]

    @staticmethod
    def segments(first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block of every segment, and segments per strip."""
        n = -(-blocks // SEGMENT)
        strip = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(strip)) - np.repeat(np.cumsum(n) - n, n)
        return first[strip] + SEGMENT * place, n

    def peaks(self, raw: np.ndarray, first: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter over each segment, and segments per strip."""
        seen = self.responses(self.inputs(raw))
        starts, n = self.segments(first, blocks)
        ends = np.minimum(starts + SEGMENT, np.repeat(first + blocks, n))
        both = np.stack([starts, ends], 1).ravel()
        return np.maximum.reduceat(seen, both[:-1] if both[-1] >= len(seen) else both, axis=0)[::2], n

    @staticmethod
    def chunks(peaks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two neighbouring segments of a text are a chunk; a text of one segment is one chunk. Chunks, and how many per text."""
        last = np.cumsum(n) - 1
        pair = np.maximum(peaks, np.concatenate([peaks[1:], peaks[-1:]]))
        kept = np.ones(len(peaks), bool)
        kept[last[n > 1]] = False
        pair[last[n == 1]] = peaks[last[n == 1]]
        return np.maximum(pair[kept], 0), np.maximum(n - 1, 1)

    def settle(self) -> Network:
        """Round the parameters: a response is a sum of multiples of 2 ** -14 below 2 ** 10, which float32 holds exactly."""
        limit = lambda v, step: (np.round(np.clip(v, -BOUND, BOUND) / step) * step).astype(np.float32)
        self.p |= {"embed": limit(self.p["embed"], EMBED_STEP)} | {k: limit(self.p[k], FILTER_STEP) for k in ("near", "far")}
        self.p["bias"] = limit(self.p["bias"], EMBED_STEP * FILTER_STEP)
        return self

    def pool(self, peaks: np.ndarray, n: np.ndarray) -> np.ndarray:
        held, m = self.chunks(peaks, n)
        held = held.astype(np.float64)  # sums of multiples of 2 ** -14: exact in any order
        at = np.cumsum(m) - m
        return np.concatenate([np.maximum.reduceat(held, at, axis=0), np.add.reduceat(held, at, axis=0) / m[:, None]], axis=1)

    def probability(self, peaks: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(n), self.constant)
        told = (self.pool(peaks, n) * self.p["top"].astype(np.float64)).sum(axis=1) + float(self.p["base"][0])
        return 1 / (1 + np.exp(-np.clip(told, -30, 30)))

    def gradients(self, raw: np.ndarray, first: np.ndarray, blocks: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(raw)
        seen = self.responses(x)
        starts, n = self.segments(first, blocks)
        ends = np.minimum(starts + SEGMENT, np.repeat(first + blocks, n))
        both = np.stack([starts, ends], 1).ravel()
        peaks = np.maximum.reduceat(seen, both[:-1] if both[-1] >= len(seen) else both, axis=0)[::2]
        held, m = self.chunks(peaks, n)
        at = np.cumsum(m) - m
        top, mean = np.maximum.reduceat(held, at, axis=0), np.add.reduceat(held, at, axis=0) / m[:, None]
        pooled = np.concatenate([top, mean], axis=1)
        error = (1 / (1 + np.exp(-np.clip(pooled @ self.p["top"] + self.p["base"][0], -30, 30))) - label) / len(label)
        down = error[:, None] * self.p["top"][None, :]
        text = np.repeat(np.arange(len(m)), m)
        # Neighbouring chunks may share a maximum: they share its gradient, too.
        first_of = held == top[text]
        on_chunk = (down[text, :FILTERS] * first_of / np.add.reduceat(first_of, at, axis=0)[text] + down[text, FILTERS:] / m[text][:, None]) * (held > 0)
        # A chunk's maximum lies in its first segment, or else in the next one.
        own = np.arange(len(peaks))[np.isin(np.arange(len(peaks)), (np.cumsum(n) - 1)[n > 1], invert=True)]
        on_peak = np.zeros_like(peaks)
        here = peaks[own] >= held
        on_peak[own] += on_chunk * here
        after = np.minimum(own + 1, len(peaks) - 1)
        np.add.at(on_peak, after, on_chunk * ~here)
        span = ends - starts
        segment = np.repeat(np.arange(len(starts)), span)
        row = np.arange(len(segment)) - np.repeat(np.cumsum(span) - span, span) + starts[segment]
        g = np.zeros_like(seen)
        g[row] = on_peak[segment] * (seen[row] == peaks[segment])
        shifted = np.concatenate([np.zeros((1, FILTERS), g.dtype), g[:-1]])
        dx = (g @ self.p["near"].T + shifted @ self.p["far"].T)[:, : BLOCK * WIDTH].reshape(-1, WIDTH)
        embed = np.stack([np.bincount(raw, dx[:, k], 256) for k in range(WIDTH)], 1)
        return {"embed": embed, "near": x.T @ g, "far": x.T @ shifted, "bias": g.sum(0), "top": pooled.T @ error, "base": np.array([error.sum()])}

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam on batches drawn without replacement, epoch after epoch."""
        labels = np.asarray(labels, np.float32)
        if len(set(labels.tolist())) < 2:
            self.constant = float((labels.sum() + 1) / (len(labels) + 2))
            return self
        r = np.random.default_rng(seed)
        self.p["base"][:] = np.log(labels.mean() / (1 - labels.mean()))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        order = np.zeros(0, int)
        arrays = [np.frombuffer(t, np.uint8) for t in texts]
        none = np.zeros(0, np.uint8)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, r.permutation(len(texts))])
            now, order = order[:batch], order[batch:]
            raw, first, blocks = lay_out([(none, arrays[k], none) for k in now])
            grads = self.gradients(raw, first, blocks, labels[now])
            speed = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g.astype(np.float32) + 1e-5 * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self.settle()

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The probability of each text (bytes as uint8); strips of bounded size, whole texts."""
        peaks: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        strips: list[tuple] = []
        owners: list[int] = []

        def flush() -> None:
            if strips:
                found, n = self.peaks(*lay_out(strips))
                peaks.append(found)
                np.add.at(counts, owners, n)
                strips.clear()
                owners.clear()

        held = 0
        for k, t in enumerate(texts):
            for a in range(0, max(1, len(t)), STRIP):
                own = t[a : a + STRIP]
                if held and held + len(own) > STRIP:
                    flush()
                    held = 0
                strips.append((t[max(0, a - LAGS) : a], own, t[a + STRIP : a + STRIP + BLOCK]))
                owners.append(k)
                held += len(own) + LAGS + BLOCK
        flush()
        return self.probability(np.concatenate(peaks), counts) if peaks else np.zeros(0)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def teaching_strips(text: F.Column, strips: int, chars: int) -> F.Column:
    """The whole text if it has at most ``chars`` characters, else as many strips as fit into it, ``strips`` at most, evenly from its
    start to its end."""
    n = F.length(text)
    m = F.least(F.lit(strips), F.ceil(n / chars).cast("int"))
    at = lambda k: 1 + F.floor(k * (n - chars) / F.greatest(m - 1, F.lit(1))).cast("int")
    return F.when(n <= chars, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.substring(text, at(k), F.lit(chars))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, strips: int = TEACH_STRIPS, chars: int = TEACH_CHARS) -> Network:
    """Fit on the ``sample`` labelled rows of least hash, of those not held out, whatever their length: ``sample`` * ``strips`` strips
    of ``chars`` characters at most reach the driver."""
    known = labels.select("doc_id", F.col("quality").alias("__y")).dropna().filter(~held_out("doc_id"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "__y").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    taught = sorted((r["doc_id"], r["__y"], r["t"]) for r in rows.select("doc_id", "__y", F.explode(teaching_strips(F.col("text"), strips, chars)).alias("t")).collect())
    return Network().fit([t.encode() for _, _, t in taught], np.array([y for _, y, _ in taught], np.float32))


def score(docs: DataFrame, network: Network, accept: float = ACCEPT) -> DataFrame:
    """docs with score and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                raw, ends = text_bytes(batch.column(batch.schema.get_field_index("text")))
                found = network.score([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                made = [pa.array(found, pa.float64()), pa.array((found >= accept).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + made, names=[*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(tidied(run), schema)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, network).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
