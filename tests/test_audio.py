"""Heads of recordings in other forms than WAVE, from streams put together by hand."""

import struct

import pytest

from talkgauge.plans.cases import wave_bytes
from talkgauge.sources.audio import audio_facts, sound_head


def flac_info(rate, channels, frames):
    return struct.pack(">HH", 4096, 4096) + bytes(6) + (rate << 44 | (channels - 1) << 41 | 15 << 36 | frames).to_bytes(8, "big") + bytes(16)


def page(body, position, serial=7, kind=0):
    return b"OggS" + bytes([0, kind]) + struct.pack("<qIII", position, serial, 0, 0) + bytes([1, len(body)]) + body


def packet(bits=9, rate=0, mono=False, fill=b""):
    size = 144 * 128_000 // (44100, 48000, 32000)[rate]
    head = (0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | bits << 12 | rate << 10 | (3 if mono else 0) << 6).to_bytes(4, "big")
    return (head + fill).ljust(size, b"\0")


def test_heads():
    assert sound_head(b"fLaC" + b"\0\0\0\x22" + flac_info(16000, 1, 16000 * 3)) == (16000, 1, 48000)
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + bytes(10)
    assert sound_head(page(vorbis, 0) + page(b"x", 44100) + page(b"x", 88200) + page(b"y", 5, serial=8) + page(b"z", -1)) == (44100, 2, 88200)
    opus = b"OpusHead" + struct.pack("<BBHI", 1, 1, 312, 16000) + bytes(3)
    assert sound_head(page(opus, 0) + page(b"x", 48312)) == (48000, 1, 48000)
    assert sound_head(page(b"\x7fFLAC\1\0\0\1fLaC\0\0\0\x22" + flac_info(8000, 2, 0), 0) + page(b"x", 8000)) == (8000, 2, 8000)
    assert sound_head(packet() * 10) == (44100, 2, 11520)
    info = bytes(32) + b"Info" + struct.pack(">II", 1, 10) + bytes(21) + (576 << 12 | 1000).to_bytes(3, "big")
    assert sound_head(b"ID3\4\0\0\0\0\0\5" + bytes(5) + packet(fill=info) + packet() * 10 + b"TAG") == (44100, 2, 11520 - 1576)
    assert sound_head(packet(mono=True, rate=2) * 4)[:2] == (32000, 1)
    assert sound_head(wave_bytes(1.0, rate=8000, channels=2)) == (8000, 2, 8000)
    facts = audio_facts(b"fLaC" + b"\0\0\0\x22" + flac_info(8000, 2, 12000), "flac")
    assert facts["duration_s"] == 1.5 and facts["narrowband"] and facts["silence_ratio"] is None and facts["stats_partial"]


@pytest.mark.parametrize("content", [b"", b"fLaC", b"OggS", b"OggS" + bytes(60), b"ID3", b"\xff\xfb", b"RIFFxxxxWAVE", b"xx", page(b"other", 0)])
def test_no_recordings(content):
    with pytest.raises((RuntimeError, ValueError, struct.error)):
        sound_head(content)
