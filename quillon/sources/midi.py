"""Standard MIDI files: bytes to event rows and back, from the public file format.

``read_midi`` parses ``binaryFile`` rows with mapInPandas, a file at a time; a file that
cannot be parsed gives one row with an error.  ``write_bytes`` renders one score.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, tpq int, track int, seq int, kind string, time long, dur long, number int, value int, text string, error string"


def _variable(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        at += 1
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            return n, at


def parse(data: bytes) -> tuple[int, list[tuple]]:
    """(ticks per quarter, rows of (track, seq, kind, time, dur, number, value, text))."""
    if data[:4] != b"MThd":
        raise ValueError("no MIDI header")
    _, _, tracks, tpq = struct.unpack(">IHHH", data[4:14])
    at, rows = 8 + struct.unpack(">I", data[4:8])[0], []
    for t in range(tracks):
        if data[at : at + 4] != b"MTrk":
            raise ValueError("no track header")
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, end, now, status, seq = at + 8, at + 8 + size, 0, 0, 0
        open_notes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        while at < end:
            delta, at = _variable(data, at)
            now += delta
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind, at = data[at], at + 1
                n, at = _variable(data, at)
                body, at = data[at : at + n], at + n
                if kind == 0x51:
                    rows.append((t, seq, "tempo", now, 0, 0, int.from_bytes(body, "big"), None))
                elif kind == 0x58:
                    rows.append((t, seq, "time_signature", now, 0, body[0], 1 << body[1], None))
                elif kind in (1, 3, 5, 6):
                    rows.append((t, seq, {1: "text", 3: "track_name", 5: "lyric", 6: "marker"}[kind], now, 0, 0, 0, body.decode("utf-8", "replace")))
            elif status in (0xF0, 0xF7):
                n, at = _variable(data, at)
                at += n
            else:
                kind, channel = status >> 4, status & 15
                a = data[at]
                b = data[at + 1] if kind not in (0xC, 0xD) else 0
                at += 1 if kind in (0xC, 0xD) else 2
                if kind == 9 and b:
                    open_notes.setdefault((channel, a), []).append((now, b, seq))
                elif kind in (8, 9):
                    if held := open_notes.get((channel, a)):
                        start, velocity, s = held.pop(0)
                        rows.append((t, s, "note", start, now - start, a, velocity, None))
                elif kind == 0xB:
                    rows.append((t, seq, "control", now, 0, a, b, None))
                elif kind == 0xC:
                    rows.append((t, seq, "program", now, 0, channel, a, None))
                elif kind == 0xE:
                    rows.append((t, seq, "pitch_bend", now, 0, channel, (b << 7 | a) - 8192, None))
            seq += 1
        at = end
    return tpq, sorted(rows, key=lambda r: (r[0], r[3], r[1]))


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    tpq, rows = parse(bytes(data))
                    yield pd.DataFrame([(p, tpq, *r, None) for r in rows], columns=names)
                except (ValueError, IndexError, struct.error) as e:
                    yield pd.DataFrame([(p, 0, 0, 0, "error", 0, 0, 0, 0, None, str(e))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _number(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def write_bytes(tpq: int, tracks: list[list[tuple]]) -> bytes:
    """A format-1 file: each track is a list of (kind, time, dur, number, value)."""
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(tracks), tpq)
    for track in tracks:
        events: list[tuple[int, int, bytes]] = []
        for kind, time, dur, number, value in track:
            if kind == "note":
                events += [(time, 1, bytes([0x90, number, value])), (time + dur, 0, bytes([0x80, number, 0]))]
            elif kind == "control":
                events.append((time, 1, bytes([0xB0, number, value])))
            elif kind == "pedal":  # an interval becomes an on and an off control
                events += [(time, 1, bytes([0xB0, 64, 127])), (time + dur, 0, bytes([0xB0, 64, 0]))]
            elif kind == "program":
                events.append((time, 0, bytes([0xC0, value])))
            elif kind == "pitch_bend":
                events.append((time, 1, bytes([0xE0, value + 8192 & 0x7F, value + 8192 >> 7])))
            elif kind == "tempo":
                events.append((time, 0, b"\xff\x51\x03" + value.to_bytes(3, "big")))
        body, now = b"", 0
        for time, _, raw in sorted(events, key=lambda e: e[:2]):
            body += _number(time - now) + raw
            now = time
        body += b"\x00\xff\x2f\x00"
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return out
