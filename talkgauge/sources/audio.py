"""Facts of audio files.

RIFF/WAVE samples (PCM or float) are decoded and measured. Of FLAC, Ogg (Vorbis, Opus, FLAC) and MP3, for which there is no
decoder here, the headers say rate, channels and length; levels are then unknown (null), with no second of sound measured.
"""

from __future__ import annotations

import io
import struct

import numpy as np

# Seconds that are measured, frame length, levels, telephone band.
MEASURED_SECONDS, FRAMES_PER_SECOND, SILENCE_DB, CLIPPED, NARROWBAND = 600, 50, -40, 0.999, 8000


def read_wave(content: bytes, seconds: int = MEASURED_SECONDS) -> tuple[int, int, int, np.ndarray]:
    """(sample rate, channels, frames in all, the first frames as float32 by channel)."""
    data = io.BytesIO(content)
    if data.read(4) != b"RIFF" or not data.read(4) or data.read(4) != b"WAVE":
        raise RuntimeError("not a RIFF/WAVE file")
    form = None
    while len(head := data.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            raw = data.read(size)
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = (struct.unpack("<H", raw[24:26])[0] if code == 0xFFFE else code, channels, rate, bits)
            data.seek(size % 2, 1)
        elif name == b"data" and form:
            code, channels, rate, bits = form
            width = channels * bits // 8
            frames = min(size, len(content) - data.tell()) // width
            raw = data.read(min(frames, rate * seconds) * width)
            return rate, channels, frames, _samples(raw, code, bits).reshape(-1, channels)
        else:
            data.seek(size + size % 2, 1)
    raise RuntimeError("no sample data")


def _samples(raw: bytes, code: int, bits: int) -> np.ndarray:
    if code == 3 and bits in (32, 64):
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float32)
    if code == 1 and bits == 8:
        return ((np.frombuffer(raw, np.uint8).astype(np.float32)) - 128) / 128
    if code == 1 and bits in (16, 32):
        return (np.frombuffer(raw, f"<i{bits // 8}") / float(1 << bits - 1)).astype(np.float32)
    if code == 1 and bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return (wide.view("<i4").ravel() / float(1 << 31)).astype(np.float32)
    raise RuntimeError(f"WAVE coding {code} with {bits} bits isn't known")


# Fixed values of MPEG audio, layer III: bit rates in kbit/s and sample rates by version (MPEG-1; MPEG-2 and 2.5).
_MP3_RATES = ((32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
_MP3_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _stream_info(block: bytes) -> tuple[int, int, int]:
    """(rate, channels, frames) of a FLAC stream's first metadata block."""
    if len(block) < 18:
        raise RuntimeError("a FLAC stream without its stream information")
    packed = int.from_bytes(block[10:18], "big")
    return packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1


def _ogg_head(content: bytes) -> tuple[int, int, int]:
    """(rate, channels, frames) of the first logical stream: its head, and the position on its last page."""
    if len(content) < 28 or content[26] == 0:
        raise RuntimeError("an Ogg file without a page")
    serial, body = content[14:18], content[27 + content[26] :]
    skip = 0
    if body[:7] == b"\x01vorbis":
        channels, rate = struct.unpack("<BI", body[11:16])
    elif body[:8] == b"OpusHead":
        channels, skip, rate = body[9], struct.unpack("<H", body[10:12])[0], 48000
    elif body[:5] == b"\x7fFLAC":
        rate, channels, _ = _stream_info(body[17:])
    else:
        raise RuntimeError("an Ogg file of another coding than Vorbis, Opus or FLAC")
    at = len(content)
    while (at := content.rfind(b"OggS", 0, at)) >= 0:
        position = content[at + 6 : at + 14]
        if content[at + 14 : at + 18] == serial and len(position) == 8 and position != b"\xff" * 8:
            return rate, channels, max(0, struct.unpack("<q", position)[0] - skip)
    raise RuntimeError("an Ogg file without a position")


def _mp3_head(content: bytes) -> tuple[int, int, int]:
    """(rate, channels, frames) by counting the packets of an MPEG layer III stream, without its encoder's padding."""
    at, found, samples, padding = 0, None, 0, 0
    if content[:3] == b"ID3" and len(content) > 10:
        at = 10 + sum((b & 127) << 7 * (3 - i) for i, b in enumerate(content[6:10]))
    while at + 4 <= len(content):
        head = int.from_bytes(content[at : at + 4], "big")
        version, layer, bits, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
        if head >> 21 != 0x7FF or version == 1 or layer != 1 or bits in (0, 15) or rate == 3:
            break
        hertz, mono = _MP3_SAMPLES[version][rate], head >> 6 & 3 == 3
        size = (144 if version == 3 else 72) * 1000 * _MP3_RATES[version != 3][bits - 1] // hertz + (head >> 9 & 1)
        if found is None:
            found = hertz, 1 if mono else 2
            # The first packet may hold a description of the stream instead of sound.
            tag = at + 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
            if content[tag : tag + 4] in (b"Xing", b"Info"):
                flags = content[tag + 7] if len(content) > tag + 7 else 0
                more = tag + 8 + 4 * (flags & 1) + 4 * (flags >> 1 & 1) + 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
                gap = int.from_bytes(content[more + 21 : more + 24], "big")
                padding = (gap >> 12) + (gap & 0xFFF)
                at += size
                continue
        samples += 1152 if version == 3 else 576
        at += size
    if found is None or not samples:
        raise RuntimeError("not an MPEG layer III stream")
    return *found, max(0, samples - padding)


def sound_head(content: bytes) -> tuple[int, int, int]:
    """(sample rate, channels, frames) of a recording in any of the forms that are known."""
    if content[:4] == b"fLaC":
        return _stream_info(content[8:42])
    if content[:4] == b"OggS":
        return _ogg_head(content)
    if content[:3] == b"ID3" or content[:1] == b"\xff":
        return _mp3_head(content)
    return read_wave(content, seconds=0)[:3]


def audio_facts(content: bytes, form: str) -> dict:
    """Duration, rate, channels, and the shares of silence and of clipped samples in the measured part."""
    if form != "wav":
        rate, channels, frames = sound_head(content)
        duration = round(frames / rate, 2) if rate else 0.0
        known = {"duration_s": duration, "sample_rate": rate, "channels": channels, "narrowband": rate <= NARROWBAND}
        return known | {"clipping_ratio": None, "silence_ratio": None, "stats_sampled_s": 0.0, "stats_partial": True}
    rate, channels, frames, data = read_wave(content)
    step = max(1, rate // FRAMES_PER_SECOND)
    n = len(data) // step
    silence = 1.0
    if n:
        mono = data.mean(axis=1)[: n * step].reshape(n, step)
        silence = float((20 * np.log10(np.sqrt((mono**2).mean(axis=1) + 1e-12)) < SILENCE_DB).mean())
    duration = round(frames / rate, 2) if rate else 0.0
    measured = round(len(data) / rate, 2) if rate else 0.0
    return {
        "duration_s": duration,
        "sample_rate": rate,
        "channels": channels,
        "narrowband": rate <= NARROWBAND,
        "clipping_ratio": round(float((np.abs(data) >= CLIPPED).mean()) if data.size else 0.0, 5),
        "silence_ratio": round(silence, 3),
        "stats_sampled_s": measured,
        "stats_partial": measured < duration,
    }
