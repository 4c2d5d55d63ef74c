import hashlib
import random
import zlib

import pytest
from cases import empty, odd

from strandloom.llm import ogg_media as O


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert O.page_checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5100, 10_199, 10_200, 10_240, 70_000, 500_001])
def test_round_trip_and_times(n):
    payload = O.padded(random.Random(n).randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) >= max(n, 64) and len(payload) - n <= 64
    back, streams, pages = O.decode(O.encode(payload))
    assert back == payload and len(streams) == O.CHANNELS
    for s in streams.values():
        assert s.clock == len(payload) // 2 and [at for at, _ in s.packets] == list(range(0, s.clock, O.PACKET_BYTES))


@pytest.mark.parametrize("channels,size", [(1, 2048), (2, 2048), (3, 255), (5, 100), (2, 70_000), (1, 200_000)])
def test_any_streams_and_packet_sizes(channels, size):
    payload = random.Random(size).randbytes(250_001)
    back, streams, _ = O.decode(O.encode(payload, channels, size))
    assert back == payload and len(streams) == channels
    pages = list(O.read_pages(O.encode(payload, channels, size)))
    assert any(p.flags & O.CONTINUED for p in pages) == (255 % (size // 255 + 1) != 0)
    assert any(p.granule == O.NO_GRANULE for p in pages) == (size >= 255 * 255)


def test_writer_has_pages_that_continue_and_lacing_that_ends_on_zero():
    pages = list(O.read_pages(O.encode(bytes(500_000))))
    assert any(p.flags & O.CONTINUED for p in pages) and any(b"\xff\x00" in p.lacing for p in pages)


def built(serial, number, flags, granule, lacing, body):
    """A page put together here, with the slow checksum."""
    page = bytearray(b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little"))
    page += bytes(4) + bytes([len(lacing), *lacing]) + body
    page[22:26] = slow_crc(page).to_bytes(4, "little")
    return bytes(page)


def head(serial, channel, channels, rate=1000):
    packet = O.HEADER + rate.to_bytes(4, "little") + bytes([channel, channels])
    return built(serial, 0, O.FIRST, 0, [len(packet)], packet)


def test_hand_built_pages():
    left, right = bytes(range(256)) + b"end", bytes(259)
    # Left: packets of 2 and 257 bytes, the second one over three pages and with granules where packets end; right: one of 255 + 0, one of 4.
    media = head(9, 0, 2) + head(4, 1, 2)
    media += built(9, 1, 0, 2, [2, 255], left[:257]) + built(4, 1, 0, 259, [255, 0, 4], right)
    media += built(9, 2, O.CONTINUED | O.LAST, 259, [2], left[257:]) + built(4, 2, O.LAST, -1, [], b"")
    payload, streams, pages = O.decode(media)
    assert payload[0::2] == left and payload[1::2] == right and pages == 6
    assert [(at, len(p)) for at, p in streams[9].packets] == [(0, 2), (2, 257)] and [(at, len(p)) for at, p in streams[4].packets] == [(0, 255), (255, 4)]
    for bad, why in (
        (head(1, 0, 1) + built(1, 1, O.LAST, 9, [4], b"four"), "goes from"),
        (head(1, 0, 1) + built(1, 2, O.LAST, 4, [4], b"four"), "missing"),
        (head(1, 0, 1) + built(1, 1, O.LAST, -1, [4], b"four"), "granule"),
        (head(1, 0, 1) + built(1, 1, O.LAST, -1, [255], bytes(255)), "does not end"),
        (head(1, 0, 1) + built(1, 1, 0, 4, [4], b"four"), "does not end"),
        (head(1, 0, 2) + built(1, 1, O.LAST, 4, [4], b"four"), "channels"),
        (head(1, 0, 1) + head(1, 0, 1), "twice"),
        (head(1, 0, 1, rate=0), "rate"),
        (b"", "channels"),
    ):
        with pytest.raises(ValueError, match=why):
            O.decode(bad)


def test_damage_is_found():
    media = O.encode(O.padded(b"abc" * 5000))
    for at in (30, 100, len(media) - 1):
        with pytest.raises(ValueError):
            O.decode(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        O.decode(media[:-10])


def test_damaged_rows_and_packets(spark):
    media = O.encode(O.padded(b"abc" * 5000))
    rows = [("a", 15_000, media), ("b", 1, media[:-1]), ("c", 1, None), (None, 1, b"text")]
    stored = spark.createDataFrame(rows, "doc_id string, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in O.inspect(stored).collect()}
    assert got["a"]["error"] is None and got["a"]["payload_bytes"] == 15_040
    assert all(got[k]["error"] and got[k]["payload_sha256"] is None and got[k]["feature"] is None for k in ("b", "c", None))
    listed = O.packets(stored).orderBy("serial", "packet").collect()
    assert {r["doc_id"] for r in listed} == {"a"} and [(r["start_us"], r["end_us"]) for r in listed[:2]] == [(0, 637_500), (637_500, 940_000)]


def test_documents(spark):
    df = odd(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in df.collect()}
    got = O.inspect(O.store(df)).collect()
    assert len(got) == df.count()
    for r in got:
        data = texts[r["doc_id"]]
        p = O.padded(data)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])
    assert O.inspect(O.store(empty(spark))).count() == 0
