"""SentencePiece BPE by a prefix table: each prefix of a text has one last token, found from automaton matches.

The encoding of a text is the chain of tokens whose neighbours are all compatible, where two tokens are compatible if the
merges of their joined text end in just these two. So the last token of a prefix is the one match of the vocabulary's automaton
that ends there and is compatible with the last token of the prefix before it; ids are then read backwards from the
end. Compatibility is told, once per pair, from what stands at the tokens' edges while merges make them. A table is made for each
distinct word: no piece of the models served here goes past the start of a run of spaces, which the loader checks. All new
words of a batch are matched as one text and their tables filled side by side, one place of each word at a time, in numpy;
long words, and those with characters that are no pieces, have their tables filled alone.

Null texts count as empty; an empty text has no ids but the end id and decodes to an empty text; equal texts have equal ids; an
empty table gives an empty result; very long words take time in proportion to their length and are kept nowhere, so what a worker
keeps is bounded in bytes; other columns pass, but for one that bears the name of the column to add, which is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.batches import kept, tidied

SPACE = "▁"
#: Words that a worker keeps, of so many characters at most; their ids are bounded with them.
KNOWN_WORDS, KEPT_CHARS = 300_000, 48
#: Slots (9 bytes each) for the pairs of tokens that a worker has told; half of them are filled at most.
PAIR_SLOTS = 1 << 21
#: Characters that are matched at once.
MATCHED = 1 << 16
_ODD = 0x9E3779B97F4A7C15  # spreads codes over slots
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Pieces:
    """The vocabulary of a model file, its automaton and the prefix table."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.byte_of = {i: int(self.text[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece of this model spans words")
        self.chars = {p for p in self.ids if len(p) == 1}
        if any(c not in self.chars for p in self.ids for c in p):
            raise ValueError("a piece of this model has a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self._build()
        self.lengths = [len(t) for t in self.text]
        self.length = np.array(self.lengths, np.int64)
        #: Whether a piece's own merges end in it: -1 is not told yet.
        self.made = np.full(n, -1, np.int8)
        self.plain = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else (" ⁇ " if i == self.unknown else t.replace(SPACE, " ")).encode() for i, t in enumerate(self.text)]
        self.pair_codes = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)
        self.n_pairs = 0
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.words: dict[str, bytes] = {}

    def merges(self, text: str) -> list[str]:
        """The model's own rule, on short texts: join the neighbours of the best score, the leftmost first."""
        parts, score = list(text), self.score
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(parts) and (both := parts[i] + parts[j]) in score:
                heapq.heappush(heap, (-score[both], i, both, j))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def spines(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and at the right edge of a piece while merges make it: (text, when it is made, when it is taken
        into the next), the whole piece first. Merges come by falling score, so a time is the worst score that one had to wait for.
        None if the merges of its text don't end in it."""
        if piece not in self.edges:
            score = self.score
            nodes = [(c, float("-inf"), None, None) for c in piece]
            while len(nodes) > 1:
                best = max(((score[both], -i) for i in range(len(nodes) - 1) if (both := nodes[i][0] + nodes[i + 1][0]) in score), default=None)
                if best is None:
                    break
                i = -best[1]
                left, right = nodes[i], nodes[i + 1]
                nodes[i : i + 2] = [(left[0] + right[0], max(-best[0], left[1], right[1]), left, right)]
            found = None
            if len(nodes) == 1:
                found = ([], [])
                for out, side in zip(found, (2, 3), strict=True):
                    node, end = nodes[0], float("inf")
                    while node is not None:
                        out.append((node[0], node[1], end))
                        node, end = node[side], node[1]
            self.edges[piece] = found
        return self.edges[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether no merge crosses from one token into the other while both are made. Where times tie, the merges are run."""
        if self.spines(right) is None or self.spines(left) is None:
            return False
        score = self.score
        for a, made_a, end_a in self.spines(left)[1]:
            for b, made_b, end_b in self.spines(right)[0]:
                crossing = score.get(a + b)
                if crossing is not None:
                    when, end = max(-crossing, made_a, made_b), min(end_a, end_b)
                    if when <= end:
                        return when == end and self.merges(left + right) == [left, right]
        return True

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of ids are compatible: told pairs stand in a table with open slots, new ones are told once."""
        code = left * len(self.text) + right
        slot = (code.astype(np.uint64) * np.uint64(_ODD) >> np.uint64(20)).astype(np.int64) % PAIR_SLOTS
        out, open_ = np.zeros(len(code), bool), np.arange(len(code))
        unknown = []
        while len(open_):
            held = self.pair_codes[slot[open_]]
            same = held == code[open_]
            out[open_[same]] = self.pair_fits[slot[open_[same]]]
            unknown.append(open_[held == -1])
            open_ = open_[~same & (held != -1)]
            slot[open_] = (slot[open_] + 1) % PAIR_SLOTS
        if len(new := np.concatenate(unknown) if unknown else open_):
            codes, which = np.unique(code[new], return_inverse=True)
            text, n = self.text, len(self.text)
            told = np.array([self.compatible(text[c // n], text[c % n]) for c in codes.tolist()], bool)
            out[new] = told[which]
            self._keep(codes, told)
        return out

    def _keep(self, codes: np.ndarray, told: np.ndarray) -> None:
        if self.n_pairs + len(codes) > PAIR_SLOTS // 2:
            self.pair_codes[:] = -1
            self.n_pairs = 0
            codes, told = codes[: PAIR_SLOTS // 2], told[: PAIR_SLOTS // 2]
        slot = (codes.astype(np.uint64) * np.uint64(_ODD) >> np.uint64(20)).astype(np.int64) % PAIR_SLOTS
        left = np.arange(len(codes))
        while len(left):
            free = left[self.pair_codes[slot[left]] == -1]
            self.pair_codes[slot[free]] = codes[free]  # of several for one slot, the last stays
            won = free[self.pair_codes[slot[free]] == codes[free]]
            self.pair_fits[slot[won]] = told[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) % PAIR_SLOTS
        self.n_pairs += len(codes)

    def whole(self, ids: np.ndarray) -> np.ndarray:
        """Which pieces the merges of their own texts end in."""
        for i in np.unique(ids[self.made[ids] < 0]).tolist():
            self.made[i] = self.spines(self.text[i]) is not None
        return self.made[ids] > 0

    def _build(self) -> None:
        """The automaton's transitions as a table with open slots, (state, character) to state, and each state's piece."""
        states, moves = {"": 0}, []
        for p in self.ids:
            at = 0
            for k in range(1, len(p) + 1):
                if (to := states.get(p[:k])) is None:
                    to = states[p[:k]] = len(states)
                    moves.append((at << 21 | ord(p[k - 1]), to))
                at = to
        self.piece_at = np.full(len(states), -1, np.int64)
        self.piece_at[[states[p] for p in self.ids]] = list(self.ids.values())
        self.bits = max(4, (4 * len(moves)).bit_length())
        self.move_codes, self.moves = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        for code, to in moves:
            slot = (code * _ODD % (1 << 64)) >> (64 - self.bits)
            while self.move_codes[slot] != -1:
                slot = (slot + 1) % (1 << self.bits)
            self.move_codes[slot], self.moves[slot] = code, to

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece in a text that ends in a line feed: the automaton runs from all places side by side."""
        at, state, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for n in range(1, len(chars) + 1):
            code = state << 21 | chars[at + (n - 1)]
            slot = (code.astype(np.uint64) * np.uint64(_ODD) >> np.uint64(64 - self.bits)).astype(np.int64)
            held = self.move_codes[slot]
            odd = np.flatnonzero((held != code) & (held != -1))
            while len(odd):
                slot[odd] = (slot[odd] + 1) & ((1 << self.bits) - 1)
                held[odd] = now = self.move_codes[slot[odd]]
                odd = odd[(now != code[odd]) & (now != -1)]
            going = np.flatnonzero(held == code)
            if not len(going):
                break
            at, state = at[going], self.moves[slot[going]].astype(np.int64)
            piece = self.piece_at[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], at[hit] + n, piece[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix of words whose characters are all pieces, at the prefix's end in their joined text
        (a line feed after each), and where each word starts there."""
        text = "\n".join(words) + "\n"
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate([[0], np.cumsum(sizes)])
        start, end, piece = self.matches(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64))
        depth = (end - np.repeat(starts[:-1], sizes)[start]).astype(np.int16)
        order = np.argsort(depth, kind="stable")
        end, piece, start, depth = end[order], piece[order], start[order], depth[order]
        last = np.full(len(text) + 2, -1, np.int64)
        last[starts[:-1]] = -2
        ends = np.searchsorted(depth, np.arange(1, (int(depth[-1]) if len(depth) else 0) + 2))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            before, here = last[start[a:b]], piece[a:b]
            good = before == -2
            good[good] = self.whole(here[good])
            inner = np.flatnonzero(before >= 0)
            good[inner] = self.fits(before[inner], here[inner])
            last[end[a:b][good]] = here[good]
        return last, starts

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words whose characters are all pieces: read backwards from the last token of each, all words side by side."""
        last, starts = self.tables(words)
        at = starts[1:] - 1
        base = starts[:-1]
        alive = np.flatnonzero(at > base)
        rows, ids = [], []
        while len(alive):
            piece = last[at[alive]]
            rows.append(alive)
            ids.append(piece)
            at[alive] -= self.length[piece]
            alive = alive[at[alive] > base[alive]]
        if not rows:
            return [b""] * len(words)
        row, step = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        raw = np.concatenate(ids)[np.lexsort((-step, row))].astype("<i4").tobytes()
        ends = 4 * np.cumsum([0, *np.bincount(row, minlength=len(words)).tolist()])
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def alone(self, word: str) -> bytes:
        """Ids of one word of any length and any characters: its table is filled place by place."""
        last: list[int] = [-1] * (len(word) + 1)
        known, chars, length = {}, self.chars, self.lengths
        for end, piece in self.automaton.iter(word):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[piece]
            # An unknown character ends a prefix without a match; nothing joins it.
            if not start or word[start - 1] not in chars:
                if self.spines(self.text[piece]) is not None:
                    last[end] = piece
            elif (left := last[start]) >= 0:
                if (pair := (left, piece)) not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[pair] = self.compatible(self.text[left], self.text[piece])
                if known[pair]:
                    last[end] = piece
        at, out = len(word), []
        while at:
            if word[at - 1] in chars:
                out.append(last[at])
                at -= length[last[at]]
            else:
                at -= 1
                out.extend(reversed(self.strange(word[at])))
        return np.array(out[::-1], "<i4").tobytes()

    def strange(self, c: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_id[b] for b in c.encode()] if self.byte_id else [self.unknown]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words that are not kept yet, and of their runs, all together."""
        plain, out, size = [], {}, 0
        parted: dict[str, list[str]] = {}

        def flush() -> None:
            out.update(zip(plain, self.encode_words(plain), strict=True))
            plain.clear()

        chars = self.chars
        for w in words:
            if len(w) > KEPT_CHARS:
                out[w] = self.alone(w)
                continue
            runs = [w]
            if not chars.issuperset(w):  # nothing joins a character that is no piece: the runs between are words
                parted[w] = ["".join(own) if plain_run else c for plain_run, own in groupby(w, chars.__contains__) for own in [[*own]] for c in (own if not plain_run else [""])]
                runs = [r for r in parted[w] if r[0] in chars and r not in self.words]
            for r in runs:
                plain.append(r)
                size += len(r) + 1
            if size > MATCHED:
                flush()
                size = 0
        if plain:
            flush()
        for w, runs in parted.items():
            out[w] = b"".join((out.get(r) or self.words[r]) if r[0] in chars else np.array(self.strange(r), "<i4").tobytes() for r in runs)
        return out

    def cut(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it as its own mark. A line feed is no piece's, so words end there too; a
        word that starts with one has no space before it."""
        if not text:
            return []
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or SPACE in text:
            return _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        return [w if w[0] == "\n" else SPACE + w for w in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts, without an end id."""
        parts = [self.cut(t) for t in texts]
        own = set().union(*parts) if parts else set()
        known = self.words
        fresh = self.learn([w for w in own if w not in known])
        short = {w: ids for w, ids in fresh.items() if len(w) <= KEPT_CHARS}
        if len(known) + len(short) > KNOWN_WORDS:  # only this batch's words stay
            held = {w: known[w] for w in own if w in known}
            known.clear()
            known.update(held)
        known.update(short)
        held = known if len(short) == len(fresh) else {w: fresh[w] if w in fresh else known[w] for w in own}
        return [b"".join(map(held.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the space put before the text goes, broken bytes become U+FFFD."""
        first = next((i for i in ids if i not in self.silent), None)
        drop = first is not None and first not in self.byte_of and self.text[first].startswith(SPACE)
        try:
            return b"".join(map(self.plain.__getitem__, ids)).decode()[drop:]
        except UnicodeDecodeError:  # runs of byte ids, each on its own
            runs = [(byte, [*own]) for byte, own in groupby((i for i in ids if i not in self.silent), self.byte_of.__contains__)]
            return "".join(_whole_bytes(b"".join(map(self.plain.__getitem__, own))) if byte else b"".join(map(self.plain.__getitem__, own)).decode() for byte, own in runs)[drop:]


def _whole_bytes(run: bytes) -> str:
    """UTF-8 where it holds; every other byte is one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def pieces_of(path: str) -> Pieces:
    """One for each worker process, so that its words and pairs outlive a task."""
    return kept("pieces", path, Pieces)


def _schema(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name] + [f"`{name}` {kind}"])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", end: bool = True) -> DataFrame:
    """df with the array ``ids`` of each text, with the end id last if ``end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        last = np.array([model.end], np.int32).tobytes() if end else b""
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [ids_of + last for ids_of in model.encode_all([t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()])]
                offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
                rest = [k for k, f in enumerate(batch.schema) if f.name != ids]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in rest] + [column], names=[batch.schema[k].name for k in rest] + [ids])

    return df.mapInArrow(tidied(run, "pieces"), _schema(df, ids, "array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each array of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column(batch.schema.get_field_index(ids))
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
                present = lists.is_valid().to_pylist()  # a null list counts as empty
                made = pa.array([model.decode(values[a:b].tolist() if here else []) for a, b, here in zip(ends[:-1], ends[1:], present, strict=True)], pa.string())
                rest = [k for k, f in enumerate(batch.schema) if f.name != text]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in rest] + [made], names=[batch.schema[k].name for k in rest] + [text])

    return df.mapInArrow(tidied(run, "pieces"), _schema(df, text, "string"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentence_pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every text encoded with an end id, and decoded again."""
    path = default_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = decode(encode(docs, path).drop("text"), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
