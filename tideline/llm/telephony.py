"""Media columns for telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, expanded to 16-bit PCM.

``store`` puts bytes into a WAV container without changing them, ``expand`` reads containers back, decodes them (lookup
tables for mu-law and A-law, numpy across blocks for ADPCM), resamples, and adds features.

Nulls count as empty; an empty or damaged container yields no samples and the format "none"; long rows are
handled in slices; equal bytes give equal results whatever their row; other columns pass through untouched unless they bear
the name of an added column, which the operator replaces. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import slices, text_bytes

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}

# Fixed values of the IMA ADPCM standard: quantiser steps and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 linear values of G.711 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of G.711 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, part + 8, part + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the change of the sample, and the next step index."""
    step, nibble = STEPS[:, None], np.arange(16, dtype=np.int32)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.clip(np.arange(len(STEPS), dtype=np.int32)[:, None] + INDEX_MOVES[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


SAMPLE_MOVE, NEXT_ROW = _moves()


def decode_adpcm(blocks: np.ndarray, slab: int = 16384) -> np.ndarray:
    """Mono IMA ADPCM: uint8[n, b] blocks to int16[n, 1 + 2 (b - 4)] samples, one numpy step for a sample of all blocks.

    A block opens with its first sample (int16, little endian), a step index (values over 88 count as 88) and a spare byte."""
    n, width = blocks.shape
    out = np.empty((n, 1 + 2 * (width - 4)), np.int16)
    for at in range(0, n, slab):
        part = blocks[at : at + slab]
        sample = part[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
        row = np.minimum(part[:, 2].astype(np.int32), len(STEPS) - 1) * 16
        codes = np.ascontiguousarray(part[:, 4:].T)
        made = np.empty((out.shape[1], len(part)), np.int16)
        made[0] = sample
        for k, both in enumerate(codes):
            for half, nibble in enumerate((both & 15, both >> 4)):
                cell = row + nibble
                sample = np.clip(sample + SAMPLE_MOVE[cell], -32768, 32767)
                row = NEXT_ROW[cell]
                made[1 + 2 * k + half] = sample
        out[at : at + slab] = made.T
    return out


def encode_adpcm(samples: np.ndarray, width: int) -> np.ndarray:
    """One block of ``width`` bytes from 1 + 2 (width - 4) samples; the plain coder, for fixtures and stores."""
    sample, row, nibbles = int(samples[0]), 0, []
    for x in samples[1:]:
        moves = SAMPLE_MOVE[row : row + 16]
        nibble = int(np.argmin(np.abs(np.clip(sample + moves, -32768, 32767) - int(x))))
        sample = int(np.clip(sample + moves[nibble], -32768, 32767))
        row = int(NEXT_ROW[row + nibble])
        nibbles.append(nibble)
    codes = np.array(nibbles, np.uint8).reshape(-1, 2)
    return np.concatenate([np.frombuffer(struct.pack("<hBB", int(samples[0]), 0, 0), np.uint8), codes[:, 0] | codes[:, 1] << 4])[:width]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample holds."""
    if rate == to or not len(pcm):
        return pcm
    n = len(pcm) * to // rate
    if to == 2 * rate:
        out = np.empty(n, np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    place = np.arange(n, dtype=np.int64) * rate
    left, rest = place // to, place % to
    right = np.minimum(left + 1, len(pcm) - 1)
    wide = pcm.astype(np.int64)
    return ((wide[left] * (to - rest) + wide[right] * rest) // to).astype(np.int16)


def wav(tag: int, rate: int, data: bytes, block: int = 1) -> bytes:
    """A mono WAV container around data."""
    bits = {PCM: 16, ADPCM: 4}.get(tag, 8)
    block = 2 if tag == PCM else block
    extra = struct.pack("<HH", 2, 1 + 2 * (block - 4)) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    speed = rate * block // (1 + 2 * (block - 4)) if tag == ADPCM else rate * block
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes] | None:
    """Format tag, rate, block size and data of a container; None if it is none of ours."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None or form[0] not in NAMES or form[1] != 1:
        return None
    return form[0], form[2], form[4], data


def to_pcm(tag: int, data: bytes, block: int) -> np.ndarray:
    """The samples of a container's data as int16; a cut last block or sample is left out."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_PCM[raw]
    if tag == ALAW:
        return ALAW_PCM[raw]
    if tag == ADPCM:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel() if block > 4 else np.zeros(0, np.int16)
    return raw[: len(raw) // 2 * 2].view("<i2").astype(np.int16)


def _add_columns(df: DataFrame, kinds: dict[str, str], make, needs: str) -> DataFrame:
    """df with columns that ``make`` computes from the Arrow column ``needs``."""
    rest = df.drop(*[c for c in kinds if c != needs])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields if f.name not in kinds] + [f"{c} {t}" for c, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(needs))
            _, offsets = text_bytes(column)
            for i, j in slices(offsets):
                kept = [batch.column(k).slice(i, j - i) for k, f in enumerate(batch.schema) if f.name not in kinds]
                names = [f.name for f in batch.schema if f.name not in kinds]
                made = make(column.slice(i, j - i))
                yield pa.RecordBatch.from_arrays(kept + list(made.values()), names=names + list(made))

    return rest.mapInArrow(run, schema)


def store(df: DataFrame, text: str = "text", media: str = "media", tag: int = MULAW, rate: int = 8000, unit: int = 64) -> DataFrame:
    """df with column ``media``: each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of ``unit``, as the 8-bit
    samples (or ADPCM blocks of ``unit`` bytes) of a WAV container, and ``n_bytes``, the bytes before padding."""

    def make(column: pa.Array) -> dict[str, pa.Array]:
        raw, at = text_bytes(column)
        sizes, out = np.diff(at), []
        for a, n in zip(at[:-1], sizes, strict=True):
            padded = max(unit, -(-n // unit) * unit)
            out.append(wav(tag, rate, raw[a : a + n].tobytes() + b"\0" * int(padded - n), unit if tag == ADPCM else 1))
        return {"n_bytes": pa.array(sizes, pa.int64()), media: pa.array(out, pa.binary())}

    kept = df.withColumn("__text", F.col(text).cast("string"))
    return _add_columns(kept, {"n_bytes": "long", media: "binary"}, make, "__text").drop("__text")


def _summed(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def features(payloads: list[bytes]) -> list[str]:
    """Of each payload read as mu-law, A-law and ADPCM: energy; for mu-law also the peak and the crossings of zero."""
    sizes = np.array([len(p) for p in payloads])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    parts, square = {}, np.arange(256)
    for name, table in (("mulaw", MULAW_PCM), ("alaw", ALAW_PCM)):
        parts[name] = _summed((table.astype(np.int64) ** 2)[raw], ends)
    loud = np.abs(MULAW_PCM.astype(np.int32))[raw]
    peak = np.maximum.reduceat(loud, ends - sizes)
    below = (MULAW_PCM[square] < 0)[raw]
    turned = np.concatenate([[False], below[1:] != below[:-1]])
    turned[ends[:-1]] = False
    crossings = _summed(turned, ends)
    blocks = raw.reshape(-1, 64)
    sums = np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), 16384):
        wide = decode_adpcm(blocks[at : at + 16384]).astype(np.float64)
        sums[at : at + 16384] = np.einsum("ij,ij->i", wide, wide).astype(np.int64)  # under 2 ** 53: exact
    adpcm = _summed(sums, ends // 64)
    return [f"mulaw:{a}:{p}:{z};alaw:{b};adpcm:{c}" for a, p, z, b, c in zip(parts["mulaw"], peak, crossings, parts["alaw"], adpcm, strict=True)]


def expand(df: DataFrame, media: str = "media", rate: int = 16000, with_features: bool = True) -> DataFrame:
    """df with what its containers hold: ``format``, ``payload`` (the stored bytes), ``pcm`` (16-bit samples at ``rate``,
    little endian) and, where payloads are whole 64-byte blocks, ``feature``."""

    def make(column: pa.Array) -> dict[str, pa.Array]:
        formats, payloads, pcms = [], [], []
        for held in column.to_pylist():
            got = read_wav(held or b"")
            if got is None:
                formats.append("none"), payloads.append(b""), pcms.append(b"")
                continue
            tag, own, block, data = got
            formats.append(NAMES[tag])
            payloads.append(data)
            pcms.append(resample(to_pcm(tag, data, block), own, rate).astype("<i2").tobytes())
        whole = [k for k, p in enumerate(payloads) if with_features and p and len(p) % 64 == 0]
        told: list[str | None] = [None] * len(payloads)
        if whole:
            for k, f in zip(whole, features([payloads[k] for k in whole]), strict=True):
                told[k] = f
        return {"format": pa.array(formats, pa.string()), "payload": pa.array(payloads, pa.binary()), "pcm": pa.array(pcms, pa.binary()), "feature": pa.array(told, pa.string()), media: column.cast(pa.binary())}

    kinds = {"format": "string", "payload": "binary", "pcm": "binary", "feature": "string", media: "binary"}
    return _add_columns(df, kinds, make, media)


def brute_row(text: str | None) -> dict:
    """The query's row for one text by plain loops, for tests."""
    body = (text or "").encode()
    payload = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
    media = wav(MULAW, 8000, payload)
    return {"n_bytes": len(body), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}


def telephony_query(spark, sf_dir: str) -> DataFrame:
    """op1: every text of documents as mu-law samples, read back from the container."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    heard = expand(store(docs).drop("text"))
    return heard.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.crc32("pcm").alias("pcm_crc32"),
    )
