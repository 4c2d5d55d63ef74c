"""Ogg as a media column: bytes are stored as 8-bit samples in Ogg pages and read back from there.

The samples are dealt to the channels of a file in turn, and each channel is a logical stream: sample i belongs to channel
i mod CHANNELS. Every stream starts with a header packet on a page of its own that names its rate, channel and the number of
channels; the pages of the streams alternate. Granule positions count the samples of a stream up to the end of the last
packet that a page completes, and are -1 on pages that complete none. Packets are a multiple of 255 bytes long, so they end
in a lacing value of 0, and most of the long ones cross pages.

Reading takes any number of streams and any packet and page sizes: it verifies each page's checksum, splits pages by serial
number, joins lacing values and continued pages into packets, and dates them: the last packet of a page ends at the granule
position, the others where the next one starts. Streams whose packets leave a gap are damaged.

Defined cases: a null text is an empty one; equal texts give equal bytes (serial numbers are fixed); repeated rows are
separate rows, an empty table gives an empty one; other columns of the input, whatever their names, are not read. A damaged or
null file keeps its row: ``error`` names the fault, what is read from the file is null, and no packets are listed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows, type_of

# Fixed values of the format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS, SEGMENT = 255, 255
NO_GRANULE = -1

HEADER = b"\x01pcm-u8\x00"
RATE = 8000
PACKET_BYTES = 20 * SEGMENT
CHANNELS = 2
SERIAL = 101  # of the first channel
PAD = 64

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start and final value 0.

    zlib has the mirrored CRC with inverted start and end: mirror bytes and result, and undo the inversions.
    """
    mirrored = ~zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) & 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def padded(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = CAPTURE + bytes([0, flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
    tail = bytes([len(lacing)]) + lacing + body
    return head + page_checksum(head + bytes(4) + tail).to_bytes(4, "little") + tail


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream; the first packet gets a page of its own."""
    number, lacing, body, granule, continued = 0, bytearray(), bytearray(), NO_GRANULE, False
    last = len(packets) - 1
    for i, (packet, end) in enumerate(packets):
        values = bytes([SEGMENT]) * (len(packet) // SEGMENT) + bytes([len(packet) % SEGMENT])
        at = 0
        while at < len(values):
            part = values[at : at + MAX_SEGMENTS - len(lacing)]
            lacing += part
            body += packet[at * SEGMENT : (at + len(part)) * SEGMENT]
            at += len(part)
            done = at == len(values)
            granule = end if done else granule
            if len(lacing) == MAX_SEGMENTS or done and (i in (0, last)):
                flags = CONTINUED * continued | FIRST * (number == 0) | LAST * (done and i == last)
                yield _page(flags, granule, serial, number, bytes(lacing), bytes(body))
                number, lacing, body, granule, continued = number + 1, bytearray(), bytearray(), NO_GRANULE, not done


def _header(rate: int, channel: int, channels: int) -> bytes:
    return HEADER + rate.to_bytes(4, "little") + bytes([channel, channels])


def encode(payload: bytes, channels: int = CHANNELS, packet_bytes: int = PACKET_BYTES) -> bytes:
    """An Ogg file whose samples are ``payload``."""
    sources = []
    for c in range(channels):
        samples = payload[c::channels]
        packets = [(samples[at : at + packet_bytes], min(at + packet_bytes, len(samples))) for at in range(0, len(samples), packet_bytes)]
        sources.append(_pages(SERIAL + c, [(_header(RATE, c, channels), 0), *packets]))
    out = bytearray()
    while sources:
        for source in list(sources):
            if (page := next(source, None)) is None:
                sources.remove(source)
            else:
                out += page
    return bytes(out)


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: memoryview


@dataclass
class Stream:
    """One logical stream while it is read."""

    rate: int = 0
    channel: int = 0
    channels: int = 0
    packets: list[tuple[int, bytes]] = field(default_factory=list)  # (first sample, bytes), without the header
    part: bytearray | None = None  # of a packet that goes on
    number: int = 0
    clock: int = 0
    ended: bool = False


def read_pages(media: bytes) -> Iterator[Page]:
    """The pages of a file, each with its checksum verified."""
    view, at = memoryview(media), 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        body = at + 27 + media[at + 26]
        lacing = media[at + 27 : body]
        end = body + sum(lacing)
        if len(lacing) < media[at + 26] or end > len(media):
            raise ValueError(f"the page at byte {at} is cut short")
        serial, number, crc = (int.from_bytes(media[at + i : at + i + 4], "little") for i in (14, 18, 22))
        if page_checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"the checksum of the page at byte {at} is wrong")
        yield Page(media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True), serial, number, lacing, view[body:end])
        at = end


def _completed(s: Stream, page: Page) -> list[bytes]:
    """The packets that a page completes; what it leaves open stays in the stream."""
    done, at = [], 0
    for x in page.lacing:
        s.part = bytearray() if s.part is None else s.part
        s.part += page.body[at : at + x]
        at += x
        if x < SEGMENT:
            done.append(bytes(s.part))
            s.part = None
    return done


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of pages."""
    streams: dict[int, Stream] = {}
    n_pages = 0
    for page in read_pages(media):
        n_pages += 1
        if (page.serial not in streams) != bool(page.flags & FIRST):
            raise ValueError(f"stream {page.serial} starts twice or not at all")
        s = streams.setdefault(page.serial, Stream())
        if s.ended or page.number != s.number or bool(page.flags & CONTINUED) != (s.part is not None):
            raise ValueError(f"pages of stream {page.serial} are missing or out of order")
        done = _completed(s, page)
        if page.number == 0:
            if len(done) != 1 or not done[0].startswith(HEADER) or len(done[0]) < len(HEADER) + 6:
                raise ValueError(f"stream {page.serial} has no header")
            s.rate, s.channel, s.channels = int.from_bytes(done[0][len(HEADER) :][:4], "little"), *done[0][len(HEADER) + 4 :][:2]
            if not s.rate:
                raise ValueError(f"stream {page.serial} has no rate")
        elif bool(done) != (page.granule != NO_GRANULE):
            raise ValueError(f"a page of stream {page.serial} has a granule position and no end of a packet, or the other way round")
        elif done:
            start = page.granule - sum(map(len, done))
            if start != s.clock:
                raise ValueError(f"stream {page.serial} goes from sample {s.clock} to {start}")
            for packet in done:
                s.packets.append((start, packet))
                start += len(packet)
            s.clock = page.granule
        s.number, s.ended = page.number + 1, bool(page.flags & LAST)
    for serial, s in streams.items():
        if s.part is not None or not s.ended:
            raise ValueError(f"stream {serial} does not end")
    return streams, n_pages


def decode(media: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """Payload, logical streams by serial number, and the number of pages."""
    streams, n_pages = demultiplex(media)
    order = sorted(streams.values(), key=lambda s: s.channel)
    if not order or any((s.channel, s.channels) != (i, len(order)) for i, s in enumerate(order)):
        raise ValueError("channels are missing or there twice")
    payload = bytearray(sum(s.clock for s in order))
    for s in order:
        if s.clock != len(range(s.channel, len(payload), len(order))):
            raise ValueError("channels differ in length")
        payload[s.channel :: len(order)] = b"".join(p for _, p in s.packets)
    return bytes(payload), streams, n_pages


def _us(sample: int, rate: int) -> int:
    return sample * 1_000_000 // rate


def feature(payload: bytes, streams: dict[int, Stream], n_pages: int) -> str:
    """What the pages and samples say, as one line; times are microseconds of granule positions."""
    order = [streams[k] for k in sorted(streams)]
    rates, packets, ends = ("+".join(map(str, v)) for v in zip(*[(s.rate, len(s.packets), _us(s.clock, s.rate)) for s in order], strict=True))
    mean = sum(payload) * 1000 // max(len(payload), 1)
    return f"ogg;rate={rates};pages={n_pages};packets={packets};ends_us={ends};mean_milli={mean};zeros={payload.count(0)}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, media``: each text as an Ogg file."""

    def one(key, text):
        data = (text or "").encode("utf-8", "surrogatepass")
        yield key, len(data), encode(padded(data))

    return map_rows(df, [id_col, text_col], one, f"`{id_col}` {type_of(df, id_col)}, n_bytes bigint, media binary", rows=64)


def inspect(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the media column back: digests of payload and media, the feature line, and what is wrong with a damaged file."""

    def one(key, n_bytes, media):
        known = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
        try:
            payload, streams, n_pages = decode(media or b"")
        except ValueError as e:
            yield key, n_bytes, None, None, None, *known, None, str(e)
            return
        digest, tail = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:])
        yield key, n_bytes, len(payload), digest, tail, *known, feature(payload, streams, n_pages), None

    schema = (
        f"`{id_col}` {type_of(stored, id_col)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string, error string"
    )
    return map_rows(stored, [id_col, "n_bytes", "media"], one, schema, rows=64)


def packets(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, serial, channel, packet, start_us, end_us, data``: the packets of every whole file, dated by granule positions."""

    def one(key, media):
        try:
            streams, _ = demultiplex(media or b"")
        except ValueError:
            return
        for serial, s in sorted(streams.items()):
            for i, (start, data) in enumerate(s.packets):
                yield key, serial, s.channel, i, _us(start, s.rate), _us(start + len(data), s.rate), data

    schema = f"`{id_col}` {type_of(stored, id_col)}, serial bigint, channel int, packet bigint, start_us bigint, end_us bigint, data binary"
    return map_rows(stored, [id_col, "media"], one, schema, rows=64)
