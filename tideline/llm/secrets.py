"""Secret scans: fixed patterns, and formats inferred from what they found.

One pass over all texts finds the base spans and the candidates: all runs of what a value of any kind may hold, as long as the
shortest value of any kind or longer, and their pieces between signs, as far as no base span touches them. The
base values, labelled by their kind, teach one probabilistic automaton per kind (a bounded sample of ``examples`` values per kind,
the least by hash). What is surely no credential, runs too short for a value of any kind, teaches the automaton of plain text: its
states are the last two classes of characters, counted over all texts, so that no candidate has a part in it. Every candidate is
then scored by every automaton; one that a kind's automaton likes as well as that kind's own examples, and clearly better than plain
text does, becomes a span of that kind, unless it lies within another such. How well a kind's own values score is told from values
that their automaton was not taught (each fold of the examples is scored by the automaton of the others); the bar lies below all of
them, and the lower the fewer they are.

Null texts count as empty and have no spans; very long texts are read whole; equal texts have equal spans; a kind without examples
adds nothing; an empty table gives an empty result. Extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.automata import Automaton, symbol
from tideline.llm.batches import tidied
from tideline.llm.scratch import materialise

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # as AKIA[A-Z0-9]+ of 18 or more: a later start in a run is shorter
HEX = re.compile(r"[0-9a-f]{16,}")  # as [0-9a-f]+ of 16 or more: runs are whole
#: All that a value of any kind may hold; none has fewer than LEAST characters.
LEAST = 12
RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Pieces of a run: without signs at its ends; without dots and names before an equals sign; tokens; letters and digits alone.
PIECES = [re.compile(p) for p in (r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9])?=*", r"[A-Za-z0-9+/_-]++=*", r"[A-Za-z0-9_-]++", r"[A-Za-z0-9]++")]
#: At most so many labelled values teach an automaton.
EXAMPLES = 300
_CLASSES = {c: symbol(chr(c)) for c in range(128)}
#: The classes of a run's characters by number; 0 is all that ends a run.
_NUMBER = {c: k for k, c in enumerate("9fzA+/_.=-", 1)}
_N = len(_NUMBER) + 1
_NUMBERS = np.array([_NUMBER.get(symbol(chr(c)), 0) if chr(c).isalnum() or chr(c) in "+/_.=-" else 0 for c in range(128)] + [0] * 128, np.int16)
#: Texts are counted together or in strips of about so many characters.
STRIP = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in code points, by start, then by kind as listed."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Runs and their pieces that touch no base span, by start, the longer first."""
    starts, ends = [], []  # of the unions of overlapping base spans
    for a, b, *_ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for m in RUN.finditer(text):
        found = {m.span()}
        if not m[0].isalnum():
            found |= {p.span() for piece in PIECES for p in piece.finditer(text, *m.span()) if p.end() - p.start() >= LEAST}
        for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
            at = bisect_right(ends, a)
            if at == len(ends) or starts[at] >= b:
                out.append((a, b, text[a:b]))
    return out


def strips(texts: list[str]) -> Iterator[str]:
    """The texts, together as far as they are short, and in strips that end between words where they are long."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > STRIP:
            end = text.find(" ", at + STRIP)
            if end < 0:
                break
            yield text[at:end]
            at = end
        held.append(text[at:] if at else text)
        size += len(held[-1])
        if size > STRIP:
            yield "\n".join(held)
            held, size = [], 0
    yield "\n".join(held)


def plain_counts(texts: list[str]) -> np.ndarray:
    """How often each class follows each two classes before it, in the runs of under LEAST characters."""
    total = np.zeros(_N**3, np.int64)
    for text in strips(texts):
        now = _NUMBERS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        edges = np.flatnonzero(np.diff(now != 0, prepend=False, append=False)).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= LEAST]:
            now[a:b] = 0
        now = np.concatenate([np.zeros(2, np.int16), now])
        code = (now[:-2] * (now[1:-1] > 0) * _N + now[1:-1]) * _N + now[2:]  # nothing before a run counts
        total += np.bincount(code[now[2:] != 0], minlength=_N**3)
    return total


class Plain:
    """The automaton of plain text: a state for every two classes. Runs are scored given their length, so ends do not count."""

    def __init__(self, counts: np.ndarray):
        shaped = counts.reshape(_N, _N, _N)
        # What two classes did not show is told by one, and that by none: each counts as one more in the state it backs.
        none = (shaped.sum((0, 1)) + 0.5) / (shaped.sum() + 0.5 * _N)
        one = (shaped.sum(0) + none) / (shaped.sum((0, 2)) + 1)[:, None]
        self.logs = np.log((shaped + one) / (shaped.sum(2) + 1)[:, :, None]).tolist()

    def score(self, text: str) -> float:
        """Mean log likelihood of a symbol."""
        total, p, q = 0.0, 0, 0
        for c in text:
            now = _NUMBER[symbol(c)]
            total += self.logs[p][q][now]
            p, q = q, now
        return total / len(text)


SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def _arrow_spans(rows: list[list[tuple]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    return pa.array([[dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in r] for r in rows], kind)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base, more, plain: the base spans and the candidates of each text; in the first row of a batch, its counts of plain text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = [[(a, b, "", v) for a, b, v in candidates(t, s)] for t, s in zip(texts, base, strict=True)]
                plain = pa.array([plain_counts(texts).tolist()] + [None] * (batch.num_rows - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_spans(base), _arrow_spans(more), plain], names=["doc_id", "base", "more", "plain"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, base {SPANS}, more {SPANS}, plain array<long>")


def bar(values: list[str], folds: int = 5) -> float:
    """The least score of a kind's values: that of examples which the automaton was not taught, and less by what so few leave open."""
    if len(values) == 1:
        return Automaton(values).score(values[0]) - 1
    folds = min(folds, len(values))
    least = min(a.score(v) for k in range(folds) for a in [Automaton([v for at, v in enumerate(values) if at % folds != k])] for v in values[k::folds])
    return min(least, *map(Automaton(values).score, values)) - 1 / len(values)


def fit(found: DataFrame, examples: int = EXAMPLES) -> tuple[dict[str, tuple[Automaton, float]], Plain]:
    """For each kind that has any example its automaton and the least score of its values; the automaton of plain text."""
    spans = found.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    taught: dict[str, list[str]] = {}
    for kind in KINDS:
        own = spans.filter(F.col("kind") == kind).select("value").distinct()
        taught[kind] = [r[0] for r in own.orderBy(F.xxhash64("value"), "value").limit(examples).collect()]
    counts = np.zeros(_N**3, np.int64)
    for at, n in found.select(F.posexplode("plain").alias("at", "n")).filter("n > 0").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    return {kind: (Automaton(values), bar(values)) for kind, values in taught.items() if values}, Plain(counts)


def likely_kind(value: str, made: dict[str, tuple[Automaton, float]], plain: Plain, margin: float = 0.1) -> str | None:
    """The kind whose automaton holds the value for one of its own; None if none does."""
    scored = [(a.score(value), -k, kind) for k, (kind, (a, least)) in enumerate(made.items()) if a.score(value) >= least]
    if not scored:
        return None
    best, _, kind = max(scored)
    return kind if best - plain.score(value) >= margin else None


def chooser(made: dict[str, tuple[Automaton, float]], plain: Plain) -> Callable[[list[tuple[int, int, str]]], list[tuple[int, int, str, str]]]:
    """What makes spans of candidates, given by start, the longer first; one within another span is left out."""
    kind_of = lambda value: likely_kind(value, made, plain)
    held = lru_cache(1 << 16)(kind_of)  # automata see classes only, so values of one format have one kind

    def choose(more: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
        out, ends = [], 0
        for a, b, value in more:
            if b > ends and (kind := (held if b - a <= 64 else kind_of)(value.translate(_CLASSES))):
                out.append((a, b, kind, value))
                ends = b
        return out

    return choose


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: base spans, and all spans (start, end, kind, value) of each text."""
    found = materialise(find(docs), "secrets")
    made, plain = fit(found)
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = chooser(made, plain)
        for batch in batches:
            rows = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = [tuple(s.values()) for s in base]
                own += choose([(s["start"], s["end"], s["value"]) for s in more])
                rows.append(sorted(own, key=lambda s: (s[0], KINDS.index(s[2]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _arrow_spans(rows)], names=["doc_id", "base", "spans"])

    return found.mapInArrow(run, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def mask(text: str, spans: list[tuple[int, int]], by: str = "[secret]") -> str:
    """The text with every union of overlapping spans replaced."""
    out, at = [], 0
    ends = 0
    for a, b in sorted(spans):
        if a >= ends:
            out += [text[at:a], by]
        ends = max(ends, b)
        at = ends
    return "".join(out) + text[at:]


def redact(docs: DataFrame, by: str = "[secret]") -> DataFrame:
    """docs with its secrets masked and n_chars, if it has one, counted again; other columns as they are. All spans are found first."""
    found = materialise(find(docs), "secrets")
    made, plain = fit(found)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = chooser(made, plain)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                new = []
                for t in texts:
                    base = base_spans(t or "")
                    own = base + choose(candidates(t or "", base))
                    new.append(mask(t, [s[:2] for s in own], by) if own else t)
                columns = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
                columns["text"] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in columns:
                    kind = batch.schema.field("n_chars").type
                    columns["n_chars"] = pa.array([c if a == b else len(a) for a, b, c in zip(new, texts, columns["n_chars"].to_pylist(), strict=True)], kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(tidied(run), docs.schema)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the secrets of every text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
