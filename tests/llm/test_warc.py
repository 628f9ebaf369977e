import base64
import gzip
import hashlib

import pytest

from hazegrid.llm import warc

from .test_packing import Memory

PAYLOADS = [b"", b"one", b"WARC/1.1\r\nnot a record", bytes(range(256)) * 300, b"\x1f\x8b\x08 magic inside", b"two" * 5000]


@pytest.fixture
def records():
    return [warc.record(i, f"http://a/{i}\n\u00e9", p, 0 if i == 3 else None) for i, p in enumerate(PAYLOADS * 3)]


@pytest.fixture(params=[True, False])
def archive(request, records):
    parts = [warc._compressed(r) if request.param else r for r in records]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    return request.param, b"".join(parts), starts


def read(data):
    found = list(warc.salvage(Memory(data)))
    spans = [(s, e) for _, s, e, _ in found]
    assert not spans or spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return {f[0] for k, _, _, f in found if k == "record"}, [x for x in found if x[0] == "gap"]


def test_whole_archive(archive):
    assert read(archive[1]) == (set(range(18)), [])


def test_members_are_ordinary_gzip(records):
    assert gzip.decompress(b"".join(map(warc._compressed, records))) == b"".join(records)


@pytest.mark.parametrize("at", range(18))
def test_damage_costs_only_its_record(archive, at):
    zipped, data, starts = archive
    for where in {starts[at], starts[at] + 5, (starts[at] + starts[at + 1]) // 2, starts[at + 1] - 6}:
        bad = bytearray(data)
        bad[where] ^= 0xFF
        ids, gaps = read(bytes(bad))
        assert ids >= set(range(18)) - {at} and (gaps or at in ids)
        assert all(starts[at] <= s and e <= starts[at + 1] for _, s, e, _ in gaps)


def test_lost_and_inserted_bytes(archive):
    zipped, data, starts = archive
    ids, gaps = read(data[:starts[4] + 9] + data[starts[6] + 20:])
    assert ids == set(range(18)) - {4, 5, 6} and len(gaps) == 1
    ids, gaps = read(data[:starts[4]] + b"garbage \x1f\x8b\x08 WARC/1" * 50 + b"\n" + data[starts[4]:])
    assert ids == set(range(18)) and gaps
    ids, gaps = read(data[:starts[17] + 30])
    assert ids == set(range(17)) and gaps[0][1] == starts[17]
    assert read(b"") == (set(), []) and read(b"nothing here")[0] == set()


def digest(p):
    return base64.b32encode(hashlib.sha1(p).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    pages = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (4, "u", ""), (7, "x", "Größe"), (None, "n", "same"), (8, "y\r\nX: 1", "z" * 300_000),
             (2, "http://b", "same"), (30, "q", "other"), (None, "m", "lonely"), (None, "m", "lonely"), (10, "r", "abc"), (11, "s", "abc")]
    d = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, sha int").repartition(3)
    got = sorted((tuple(r) for r in warc.warc_round_trip(d, least).collect()), key=str)
    body = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, b in body:
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, b in body:
        rev = b in first and i != first[b] and sum(x == b for _, x in body) > 1
        want.append((i, len(b), digest(b), "revisit" if rev else "response", first[b] if rev else None))
    assert got == sorted(want, key=str)


def test_gaps_are_logged_by_file(spark, tmp_path, records):
    data = b"".join(map(warc._compressed, records))
    (tmp_path / "a.warc.gz").write_bytes(data[:1000] + b"\0" * 100 + data[1000:])
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),), (str(tmp_path / "b.warc"),)], "path string")
    found, gaps = warc.read_warc(files)
    assert found.count() >= 34 and {r.path for r in gaps.collect()} == {str(tmp_path / "a.warc.gz")}


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
