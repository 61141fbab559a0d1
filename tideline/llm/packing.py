"""Best-fit packing after Martello-Toth dominance reduction.

Texts become token ids, ids become pieces of at most ``capacity``, and only the number of pieces of each length (at most
``capacity`` numbers, whatever the input) reaches the driver. There the reduction fixes sets that provably dominate every other
set holding the same piece, best-fit decreasing packs the rest, both on whole counts, and the plan goes back as a table of a few
thousand slots: a piece finds its sequence by its length and its number among the pieces of that length. These numbers are dealt
out over parts of each length, as many as its count asks for, so a length that most pieces share is no single task.

Null texts count as empty; an empty text is a piece of one token (the end id); very long texts are cut into as many pieces as they need; rows that are repeated are packed as often as they
come; an empty table gives an empty result; ties go by (doc_id, piece, start); other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.batches import kept, tidied
from tideline.llm.scratch import materialise

CAPACITY, END_ID = 1024, 2
#: Words that a worker keeps, of so many characters at most.
KNOWN_WORDS, KEPT_CHARS = 200_000, 64
#: Pieces of one length that are numbered as one part, and into how many parts each length goes at least. With its ids a whole
#: piece has 4 KB, so a part has 80 MB at most; the driver gets a row for each part.
PART, PARTS = 20_000, 64
_SPACED = re.compile(r" (?=\S)")


#: The pre-tokens of byte-level BPE, and the bytes that its vocabulary writes as themselves.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Words with characters from here on go to the tokenizer itself, whose tables of letters may be of another year.
LATIN_END = "\u0250"


def ranks_of(path: str, special: set[str]) -> dict[bytes, int] | None:
    """The tokens of a tokenizer's file by their bytes, if it is byte-level BPE whose merges stand in the order of the tokens they make,
    so that ids are ranks; None if any of that does not hold."""
    told = json.loads(open(path, encoding="utf-8").read())
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    vocabulary = model["vocab"]
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([-1, *made], made, strict=False)):
        return None
    own, rest = set(PRINTED), iter(range(256, 512))
    byte_of = {chr(b) if b in own else chr(next(rest)): b for b in range(256)}
    singles = {t for t in vocabulary if t not in special and len(t) == 1}
    if singles != set(byte_of) or len(made) + len(singles) + len(special & set(vocabulary)) != len(vocabulary):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class WordTokens:
    """Ids of texts by a tokenizer of byte-level BPE, with the ids of words kept.

    Such a tokenizer starts a new pre-token at every space before a character that isn't white space, and at a line feed between
    two such characters. So a text is cut there, and each distinct part is encoded once: all new words of a batch as one text, whose
    tokens tell where a word begins. Texts with other runs of white space are cut less and keep nothing. Words of over KEPT_CHARS
    characters are encoded where they come and not kept, so that what is kept is bounded in bytes."""

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.fast = None
        if ranks := ranks_of(path, special):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]  # how the vocabulary writes a space
        vocabulary = self.tokenizer.get_vocab(False)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == space and t not in special]] = True
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _together(self, words: list[str], opens) -> list[bytes]:
        """Ids of words that each open with one known kind of token and have none inside."""
        if not words:
            return []
        text = "".join(words)
        flat = np.array(self.fast.encode_ordinary(text) if self.fast and max(text) < LATIN_END else self.encode([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(opens(flat))
        if len(at) != len(words):
            return self._ids(words)
        raw, ends = flat.tobytes(), (4 * np.append(at, len(flat))).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _learn(self, words: list[str]) -> dict[str, bytes | None]:
        """Ids of words; None for white space that may belong to the next part: such texts go another way."""
        # Printable ASCII without a control string, as most words are, needs no look at its ends.
        clear = not self.special.search("\n".join(words))
        inner = [w for w in words if w and w.isascii() and w.isprintable()] if clear else []
        rest = [w for w in words if not (w and w.isascii() and w.isprintable())] if clear else words
        found: dict[str, bytes | None] = dict.fromkeys(rest)
        lines, other, apart = [], [], []
        for w in rest:
            line = w[:1] == "\n"
            if not w or w == "\n" or w[-1:].isspace() or w[line : line + 1].isspace():
                continue
            if not clear and self.special.search(w):
                apart.append(w)
            elif line:
                lines.append(w)
            else:
                (inner if max(w) < LATIN_END else other).append(w)
        feed = int(np.frombuffer(self.feed, "<u4")[0])
        for own in (inner, other):
            found.update(zip(own, self._together([f" {w}" for w in own], lambda ids: self.spaced[ids]), strict=True))
        found.update(zip(lines, self._together(lines, lambda ids: ids == feed), strict=True))
        found.update(zip(apart, self._ids([w if w[0] == "\n" else f" {w}" for w in apart]), strict=True))
        return found

    def _plain(self, text: str) -> bytes:
        first, *rest = _SPACED.split(text)
        return b"".join(self._ids([first, *[f" {w}" for w in rest]]))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        parts = [f"\n{t}".replace("\n", " \n").split(" ")[1:] for t in texts]
        words = set().union(*parts)
        new = [w for w in words if w not in known]
        if new:
            short = [w for w in new if len(w) <= KEPT_CHARS]
            if len(known) + len(short) > self.limit:
                known.clear()
                short = [w for w in words if len(w) <= KEPT_CHARS]
            known.update(self._learn(short))
            if long := [w for w in new if len(w) > KEPT_CHARS]:
                known = {w: known[w] for w in words if len(w) <= KEPT_CHARS} | self._learn(long)
        skip = len(self.feed)
        for text, words in zip(texts, parts, strict=True):
            try:
                yield b"".join(map(known.__getitem__, words))[skip:]
            except TypeError:
                yield self._plain(text)


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, so that its words outlive a task."""
    return kept("packing", path, WordTokens)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of every piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = word_tokens(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), made.ids([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        held = ids[4 * start : 4 * (start + length)]
                        out.append((doc_id, k, start, length, zlib.crc32(held), held if with_ids else None))
                columns = list(zip(*out, strict=True))
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(tidied(run, "packing"), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


def _best_pair(sizes: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of two pieces that fits into room; 0 if none does."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        if sizes[i] + sizes[j] > room:
            j -= 1
        else:
            if i < j or left[sizes[i]] > 1:
                best = max(best, sizes[i] + sizes[j])
            i += 1
    return best


def reduce_instance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that some best packing holds, as (lengths, how often), and the pieces that remain.

    For a piece j, with pieces sorted by length, a set dominates if every other feasible set of j can be mapped into it:
    j alone if nothing fits beside it; j with a piece that fills the bin; j with the largest that fits, if no two others fit, or
    if at most two others fit and no two are longer together than that one."""
    left, fixed, again = {s: c for s, c in counts.items() if c > 0}, [], True

    def take(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for s in items:
            left[s] -= times
            if not left[s]:
                del left[s]

    def times_of(j: int, k: int) -> int:
        return left[j] // 2 if j == k else min(left[j], left[k])

    while again:
        again = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                sizes = sorted(left)
                low = [s for s in sizes[:4] for _ in range(min(left[s] - (s == j), 3))][:3]
                if not low or low[0] > room:
                    take((j,), left[j] if not low or j > room else 1)
                    again = True
                    continue
                if room in left and times_of(j, room):
                    take((j, room), times_of(j, room))
                    again = True
                    continue
                fits = [s for s in sizes if s <= room and left[s] > (s == j)]
                k = fits[-1]
                pair = sum(low[:2]) <= room if len(low) > 1 else False
                triple = sum(low) <= room if len(low) > 2 else False
                others = left | {j: left[j] - 1}
                if not pair or (not triple and k >= _best_pair([s for s in sizes if others[s]], others, room)):
                    # What is taken away only shortens the rivals, so the reason holds as long as both last.
                    take((j, k), times_of(j, k))
                    again = True
                    continue
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: each piece goes to the open bin with the least room that holds it."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, items: tuple[int, ...], times: int) -> None:
        if times:
            bins.setdefault(room, []).append((items, times))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            room = min((r for r in bins if r >= s), default=None)
            items, times = bins[room].pop() if room is not None else ((), c)
            if room is not None and not bins[room]:
                del bins[room]
            each = (room or capacity) // s  # a bin that took one has the least room that holds the next
            full = min(times, c // each)
            put((room or capacity) - each * s, items + (s,) * each, full)
            c -= full * each
            if room is None:
                if c:
                    put(capacity - c * s, (s,) * c, 1)
                    c = 0
            elif full < times:
                part = min(c, each) if full == 0 or c < each else 0
                if part:
                    put(room - part * s, items + (s,) * part, 1)
                    c -= part
                put(room, items, times - full - (part > 0))
    return [b for held in bins.values() for b in held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, offset), ascending; numbers run over the pieces of that length."""
    used: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for items, times in bins:
        offset = 0
        for s in items:
            found.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in found.items()}


def pack(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. cut_docs: doc_id, piece, start, length and any more."""
    spark = cut_docs.sparkSession
    held = materialise(cut_docs.withColumn("__hash", F.xxhash64("doc_id", "piece", "start")), "pieces")
    # ``capacity`` rows at most; then PARTS for each of them, and one more for every PART pieces.
    sizes = held.groupBy("length").count().collect()
    parts = spark.createDataFrame([(r["length"], max(PARTS, -(-r["count"] // PART))) for r in sizes], "length long, __parts long")
    held = held.join(F.broadcast(parts), "length").withColumn("__part", F.pmod("__hash", "__parts")).drop("__hash", "__parts")
    dealt = sorted((r["length"], r["__part"], r["count"]) for r in held.groupBy("length", "__part").count().collect())
    counts: dict[int, int] = {}
    base = []
    for length, part, n in dealt:
        base.append((length, part, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    table = slots(plan(counts, capacity))
    first = spark.createDataFrame(base, "length long, __part long, __first long")
    number = F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "start"))
    ranked = held.withColumn("__number", number).join(F.broadcast(first), ["length", "__part"]).withColumn("__rank", (F.col("__first") + F.col("__number") - 1).cast("long"))
    names = cut_docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cut_docs.schema.fields] + ["sequence_id long", "offset long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                own, rows = length == s, table[int(s)]
                k = np.searchsorted(rows[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = rows[k, 1] + rank[own] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "__rank").mapInArrow(tidied(run, "packing"), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents in as few sequences of 1024 tokens as best-fit finds."""
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()))
