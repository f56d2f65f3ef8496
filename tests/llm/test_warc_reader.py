"""Records around bad ones."""

import gzip

from framequarry.llm import warc


def good(i):
    return warc.record_bytes(f"https://h.example.test/{i}", f"2026-01-0{i + 1}T00:00:00Z", 200, {"ETag": "x"}, b"body\r\n" * i, record_id=f"r{i}")


def read(data):
    rows = list(warc.records(data))
    return [r["record_id"] for r in rows if r["error"] is None], [(r["record_id"], r["error"]) for r in rows if r["error"]]


def test_a_record_without_length():
    bad = good(9).replace(b"Content-Length", b"Content-Size")
    for pack in (lambda x: x, gzip.compress):
        data = b"".join(pack(x) for x in (good(0), good(1), bad, good(2), good(3)))
        assert read(data) == (["r0", "r1", "r2", "r3"], [("r9", "no length")])


def test_other_bytes_and_wrong_lengths():
    assert read(good(0) + b"noise\r\nmore noise\r\n" + good(1)) == (["r0", "r1"], [(None, "bytes between records")])
    size = good(2).split(b"Content-Length: ")[1].split(b"\r\n")[0]
    too_long = good(2).replace(b"Content-Length: " + size, b"Content-Length: 999999")
    found, bad = read(good(0) + too_long + good(1))
    assert found == ["r0", "r1"] and bad[0][0] == "r2" and bad[0][1].endswith("of 999999 bytes")


def test_ends():
    assert read(b"") == ([], []) and read(b"\r\n\r\n") == ([], [])
    found, bad = read(good(0) + good(3)[:-30])
    assert found == ["r0"] and len(bad) == 1 and bad[0][0] == "r3"
