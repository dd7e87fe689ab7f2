"""Media columns: audio features of 8-bit sound, as fixed-shape Arrow tensors with time spans.

`store` keeps bytes losslessly as 8-bit mono WAV; `audio_features` reads the stored bytes back, resamples them with a
polyphase filter, takes overlapped log-mel frames, cuts these in tensors of one shape, and marks the loud stretches with
two thresholds (hysteresis). All of it is per row and map-only, so equal rows get equal values; `write` keeps it as a table.
A null or empty text is stored as its padding alone; null media gives null features. A very long text is read in steps, so a
row takes little more than its media and tensors. A frame exactly at a threshold is loud at ON and not yet quiet at OFF. Rows
that repeat stay, an empty table gives no rows, and other columns don't matter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pick, slices

RATE = 8000
#: Resampling by UP / DOWN, with TAPS input samples in each output sample.
UP, DOWN, TAPS = 3, 4, 24
FRAME, HOP, MELS = 256, 128, 24
#: Frames in one tensor.
BLOCK = 64
#: dB above the median energy at which a stretch begins, and below which it ends.
ON, OFF = 3.0, 1.0
UNIT = 192
#: Frames that one step makes.
STEP = 1024


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF file."""
    pad = b"\0" * (len(samples) % 2)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def read_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono PCM file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def payload(text: str | None) -> bytes:
    """The text as UTF-8 with blanks behind it, up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def _filters() -> np.ndarray:
    """The windowed-sinc low-pass as a column for each output phase, over TAPS input samples."""
    out = np.zeros((TAPS, UP))
    cut = min(1.0, UP / DOWN)
    for phase in range(UP):
        t = np.arange(TAPS) - (TAPS // 2 - 1) - phase * DOWN / UP % 1 - phase * DOWN // UP
        x = np.sinc(cut * t) * cut * np.where(np.abs(t) < TAPS / 2, 0.5 + 0.5 * np.cos(2 * np.pi * t / TAPS), 0)
        out[:, phase] = x / x.sum()
    return out.astype(np.float32)


def _mel() -> np.ndarray:
    """Triangles of equal width on the mel scale, over the bins of a frame's spectrum."""
    top = RATE * UP / DOWN / 2
    to_mel, to_hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = to_hz(np.linspace(0, to_mel(top), MELS + 2))
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - f) / np.diff(edges)[1:]
    out = np.maximum(0, np.minimum(rise, fall))
    return (out / np.maximum(out.sum(0), 1e-9)).astype(np.float32)


_FILTERS, _MEL = _filters(), _mel()
_WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def resample(x: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Polyphase: every DOWN input samples give UP output samples, each phase with its own filter; silence beyond the end.

    x: float32, or unsigned bytes, of which only the stretch that is needed becomes numbers. lo, hi: the output samples wanted.
    """
    total = len(x) * UP // DOWN
    hi = total if hi is None else hi
    first, last = lo // UP, -(-hi // UP)  # groups of UP output samples
    begin, end = first * DOWN - (TAPS // 2 - 1), last * DOWN + TAPS
    part = x[max(0, begin) : max(0, min(len(x), end))]
    wide = np.zeros(end - begin, np.float32)
    wide[max(0, -begin) : max(0, -begin) + len(part)] = (part.astype(np.float32) - 128) / 128 if x.dtype == np.uint8 else part
    frames = np.lib.stride_tricks.as_strided(wide, (last - first, TAPS), (4 * DOWN, 4))
    out = (frames @ _FILTERS).ravel()[lo - first * UP : hi - first * UP]
    out[max(0, total - lo) :] = 0
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """dB in each band of each overlapped frame of the resampled sound, STEP frames at a time; the last one ends in silence."""
    n = 1 + max(0, -(-(len(x) * UP // DOWN - FRAME) // HOP))
    parts = []
    for k in range(0, n, STEP):
        m = min(STEP, n - k)
        wide = resample(x, k * HOP, (k + m - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.as_strided(wide, (m, FRAME), (4 * HOP, 4))
        spectrum = np.fft.rfft(frames * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        parts.append(np.round(10 * np.log10(power @ _MEL + np.float32(1e-6)), 2).astype(np.float32))
    return np.concatenate(parts)


def stretches(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames of the loud stretches: one begins above the median by ON dB, and ends below the median by OFF dB."""
    middle = float(np.median(energy))
    state = np.where(energy >= middle + ON, 1, np.where(energy < middle + OFF, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    loud = np.concatenate([[0], np.where(known >= 0, state[np.maximum(known, 0)], 0), [0]])
    turns = np.flatnonzero(np.diff(loud))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


_SHAPE = pa.fixed_shape_tensor(pa.float32(), [BLOCK, MELS], dim_names=["frame", "mel"])
_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", _SHAPE)])


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: a fixed-shape tensor for every BLOCK frames, with its time span; the last is filled with -60 dB."""
    blocks = -(-len(mel) // BLOCK)
    full = np.full((blocks * BLOCK, MELS), -60, np.float32)
    full[: len(mel)] = mel
    second = HOP * DOWN / (RATE * UP)
    start = np.arange(blocks) * BLOCK * second
    end = np.minimum((np.arange(blocks) + 1) * BLOCK, len(mel)) * second
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), BLOCK * MELS)
    batch = pa.record_batch([pa.array(np.round(start, 6)), pa.array(np.round(end, 6)), pa.ExtensionArray.from_storage(_SHAPE, storage)], schema=_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _SCHEMA) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """start_s, end_s and log_mel (fixed-shape tensors) of one row."""
    return pa.ipc.open_stream(data).read_all()


def features(samples: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """The tensors, and the loud stretches in seconds."""
    x = np.frombuffer(samples, np.uint8)
    mel = log_mel(x) if len(x) else np.zeros((0, MELS), np.float32)
    second = HOP * DOWN / (RATE * UP)
    loud = stretches(mel.mean(1)) if len(mel) else []
    return tensors(mel), [(round(a * second, 6), round(b * second, 6)) for a, b in loud]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text as UTF-8) and media (WAV) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([wav(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(rows: DataFrame) -> DataFrame:
    """The rows with samples (binary, read back from media), tensors (binary: an Arrow IPC stream) and loud (spans in s)."""
    at = rows.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for part in slices(batches, "media", 1 << 20):
            samples = [m if m is None else read_wav(m)[0] for m in part.column(at).to_pylist()]
            found = [(None, None) if s is None else features(s) for s in samples]
            loud = [x and [{"start_s": a, "end_s": b} for a, b in x] for _, x in found]
            yield pa.record_batch([*part.columns, pa.array(samples, pa.binary()), pa.array([x for x, _ in found], pa.binary()), pa.array(loud, spans)], [*part.schema.names, "samples", "tensors", "loud"])

    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, samples binary, tensors binary, loud array<struct<start_s:double,end_s:double>>")


def write(docs: DataFrame, path: str) -> None:
    """A Parquet table of doc_id, n_bytes, media, tensors and loud of every row."""
    audio_features(store(docs)).drop("samples").write.parquet(path)


def op2_audio_features(spark, sf_dir: str) -> DataFrame:
    """The contract's digests; with them the loud stretches themselves, and the number of tensors."""
    rows = audio_features(store(documents(spark, sf_dir)))
    size = lambda c: F.length(c).cast("long")
    feature = F.concat_ws(":", F.size("loud"), F.sha2(F.to_json("loud").cast("binary"), 256).substr(1, 16), F.sha2("tensors", 256))
    frames = F.greatest(F.lit(1), F.ceil((F.floor(size("samples") * UP / DOWN) - FRAME) / HOP) + 1)
    return rows.select("doc_id", "n_bytes", size("samples").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.expr("substring(samples, -16)")).alias("tail_crc32"), size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "loud", F.ceil(frames / BLOCK).cast("long").alias("n_tensors"))
