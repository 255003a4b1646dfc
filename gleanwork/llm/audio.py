"""Media columns: 8-bit PCM audio and its features as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

RATE, TARGET = 16_000, 8_000
WINDOW, HOP, FFT, MELS = 200, 80, 256, 40  # at TARGET: 25 ms windows, every 10 ms
SPAN_FRAMES = 32  # frames of one tensor
#: Hysteresis: a segment starts above ON and ends below OFF, both relative to the mean frame energy (natural log).
ON, OFF = 0.05, -0.05
BLOCK_FRAMES = 8192  # frames worked on at once, so that long texts take bounded memory


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples, one for each byte."""
    n = len(payload)
    pad = b"\0" * (n % 2)
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", n) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of a RIFF file as encode_wav writes it; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache
def _lowpass(up: int, down: int, taps_per_phase: int = 12) -> np.ndarray:
    """Windowed sinc, as `up` phases of taps."""
    n = taps_per_phase * max(up, down)
    n += -n % up
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hamming(n + 1)[:n] / max(up, down) * up
    return h.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling by a polyphase filter: ceil(len * up / down) samples; only those that are kept are computed."""
    h = _lowpass(up, down)
    n_out = -(-len(x) * up // down)
    if not n_out:
        return np.zeros(0, np.float32)
    delay, out = len(h) // 2, np.zeros(n_out, np.float32)
    # Output m is sum over j of h[j] * u[m * down + delay - j], u being x with up - 1 zeros after each sample.
    # In one phase of outputs, m = r + i * up, the same taps meet x at steps of `down`.
    for r in range(up):
        first = r * down + delay
        taps = h[first % up :: up]
        base = first // up
        count = -(-(n_out - r) // up)
        if count <= 0:
            continue
        need = base + (count - 1) * down + 1
        padded = np.concatenate([np.zeros(len(taps) - 1, np.float32), x[:need], np.zeros(max(0, need - len(x)), np.float32)])
        acc = np.zeros(count, np.float32)
        for k, tap in enumerate(taps):  # x[base + i * down - k]
            start = base - k + len(taps) - 1
            acc += tap * padded[start : start + (count - 1) * down + 1 : down]
        out[r::up] = acc
    return out


@lru_cache
def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FFT, 1 / TARGET)
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies of overlapping windows, [frames, MELS]; the last window is filled with zeros; at least one."""
    frames = max(1, 1 + -(-max(0, len(x) - WINDOW) // HOP))
    x = np.pad(x, (0, (frames - 1) * HOP + WINDOW - len(x))) if len(x) < (frames - 1) * HOP + WINDOW else x
    view = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:frames]
    out, hann, bank = np.empty((frames, MELS), np.float32), np.hanning(WINDOW).astype(np.float32), _mel_bank()
    for at in range(0, frames, BLOCK_FRAMES):
        spectrum = np.fft.rfft(view[at : at + BLOCK_FRAMES] * hann, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        out[at : at + BLOCK_FRAMES] = np.log(power.astype(np.float32) @ bank + np.float32(1e-6))
    return out


def hysteresis(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of frames that begin at a frame above `on` and last while frames are at least `off`."""
    state = np.where(energy > on, 1, np.where(energy < off, -1, 0))
    marks = np.flatnonzero(state)
    if not len(marks):
        return []
    last = np.zeros(len(energy), np.int64)
    last[marks] = marks
    last = np.maximum.accumulate(last)
    active = np.concatenate([[0], (state[last] == 1).astype(np.int8), [0]])
    edge = np.diff(active)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float, int]]]:
    """Tensors [n, SPAN_FRAMES, MELS] (float16) and for each its start and end in seconds and its number of true frames.

    Segments of speech-like energy are cut into spans of at most SPAN_FRAMES frames; the last of a segment is filled
    with zeros. Equal samples give equal features. Where energy stays so even that no frame stands out (a text of one frame,
    silence), all frames are one segment: every text has a span.
    """
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    g = int(np.gcd(rate, TARGET))
    mel = log_mel(resample(x, TARGET // g, rate // g))
    energy = mel.mean(axis=1)
    energy = energy - energy.mean()
    segments = hysteresis(energy, ON, OFF) or [(0, len(energy))]
    spans = [(a, min(a + SPAN_FRAMES, end)) for start, end in segments for a in range(start, end, SPAN_FRAMES)]
    out = np.zeros((len(spans), SPAN_FRAMES, MELS), np.float16)
    for k, (a, b) in enumerate(spans):
        out[k, : b - a] = mel[a:b]
    step = HOP / TARGET
    return out, [(round(a * step, 4), round(b * step, 4), b - a) for a, b in spans]


def tensor_bytes(tensors: np.ndarray) -> bytes:
    """Tensors [n, SPAN_FRAMES, MELS] as an Arrow stream of one column, `tensor`, of fixed shape: what the column `tensors` holds."""
    kind = pa.fixed_shape_tensor(pa.float16(), (SPAN_FRAMES, MELS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), SPAN_FRAMES * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat)], ["tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensor_array(binary: bytes) -> pa.Array:
    """The `tensors` column of one row as Arrow's fixed-shape tensor array."""
    with pa.ipc.open_stream(binary) as reader:
        return reader.read_all().column("tensor").combine_chunks()


MEDIA = "key long, n_bytes long, media binary, samples binary, spans array<struct<start_s:double,end_s:double,frames:int>>, tensors binary"


def _media(batches):
    import pyarrow as pa

    spans_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
    names = ["key", "n_bytes", "media", "samples", "spans", "tensors"]
    for batch in batches:
        rows, held = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            payload = data + b"\0" * ((-len(data)) % 64 or (64 if not data else 0))
            media = encode_wav(payload)
            rate, samples = decode_wav(media)
            tensors, spans = features(samples, rate)
            rows.append((key, len(data), media, samples, [dict(zip(("start_s", "end_s", "frames"), s)) for s in spans], tensor_bytes(tensors)))
            held += 4 * len(media)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(pa, spans_type))], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _types(pa, spans_type))], names)


def _types(pa, spans_type):
    return [pa.int64(), pa.int64(), pa.binary(), pa.binary(), spans_type, pa.binary()]


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, n_bytes, media (the WAV file), samples (read back from it), spans and tensors.

    The UTF-8 bytes of the whole text, and zeros up to a positive multiple of 64, are the samples. Null text: empty.
    Null keys are kept. Repeated rows: each gets its own result. Very long texts are worked on in blocks of frames.
    No rows: no result rows. Columns other than key and text aren't read, so their names can't clash.
    """
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_media, MEDIA)


def op1_audio_features(spark, sf_dir):
    made = media_column(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("key").alias("doc_id"),
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64, 64)")).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("spans="), F.size("spans")),
            F.concat(F.lit("frames="), F.coalesce(F.expr("aggregate(spans, 0L, (a, s) -> a + s.frames)"), F.lit(0))),
            F.concat(F.lit("seconds="), F.round(F.coalesce(F.expr("aggregate(spans, 0D, (a, s) -> a + s.end_s - s.start_s)"), F.lit(0.0)), 2)),
            F.concat(F.lit("tensor="), F.sha2("tensors", 256)),
        ).alias("feature"),
        F.size("spans").alias("n_spans"),
    )
