"""Media columns: texts as 8-bit WAV sound, short-time spectra and spectral-peak fingerprints.

The payload is the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of ``FRAME``; each byte is one
unsigned 8-bit mono sample. The stored form is a whole WAV file, written and read back with the wave module. Spectra are
real Fourier transforms of Hann-windowed frames, one for every FRAME samples. A frame's landmarks are its strongest bin
in a low and in a high band; each is paired with the landmarks of the next ``AHEAD`` frames, and a pair is kept as the
time of its first frame and the code ``(bin << 22) | (other bin << 8) | frames between``.

Defined results: null and empty texts give one frame of bytes 255; equal texts give equal values wherever they stand
(each text is transformed on its own); repeated rows are kept; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from huegrid.llm.common import table

FRAME, RATE, AHEAD, CHUNK = 576, 8000, 2, 4096
HANN = np.hanning(FRAME).astype(np.float32)
BANDS = ((2, 72), (72, FRAME // 2 + 1))
NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "pairs"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
SCHEMA = "doc_id {}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, pairs array<int>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME), len(data)


def to_wav(payload: bytes) -> bytes:
    store = io.BytesIO()
    with wave.open(store, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return store.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono sound")
        return w.readframes(w.getnframes())


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the pairs of spectral peaks."""
    frames = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    peaks = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), CHUNK):
        some = (frames[i : i + CHUNK].astype(np.float32) - np.float32(128)) * HANN
        spectrum = np.fft.rfft(some, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for k, (low, high) in enumerate(BANDS):
            peaks[i : i + CHUNK, k] = low + power[:, low:high].argmax(1)
    times, codes = [], []
    for gap in range(1, AHEAD + 1):
        if len(peaks) > gap:
            code = (peaks[:-gap, :, None] << 22) | (peaks[gap:, None, :] << 8) | gap
            codes.append(code.reshape(len(code), -1))
            times.append(np.broadcast_to(np.arange(len(code))[:, None], codes[-1].shape))
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    t, c = np.concatenate([x.ravel() for x in times]), np.concatenate([x.ravel() for x in codes])
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def features(text: str | None) -> tuple:
    payload, n = payload_of(text)
    media = to_wav(payload)
    back = from_wav(media)
    times, codes = fingerprint(back)
    digest = hashlib.sha1(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes()).hexdigest()
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(back) // FRAME}:{len(codes)}:{digest}", times, codes


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
        made = [pa.array(c, t) for c, t in zip(columns[:-2], TYPES[:-2], strict=True)] + [_lists(list(c)) for c in columns[-2:]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", *NAMES])


def media_features(docs: DataFrame) -> DataFrame:
    """The columns of the module's text for every row; the sound itself is not kept (``to_wav`` makes it again)."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_media, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def op6_media_columns(spark, sf_dir) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
