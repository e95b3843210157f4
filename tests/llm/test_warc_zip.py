import hashlib
import io
import zipfile
import zlib

import pytest
from shelfline.llm import warc_zip as w


def opened(data):
    return w.Package(lambda at, n: data[at : at + n], len(data))


def filled(n=5):
    writer = w.PackageWriter()
    for i in range(n):
        body = f"<p>{i} é</p>".encode()
        writer.add(f"http://x/{i} a\n", w.record(i, f"http://x/{i} a\n", body, len(body), hashlib.sha1(body).hexdigest(), None))
    return writer


def test_packages_are_zip_files():
    data = filled().close(b"note")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.comment == b"note"
        assert z.namelist() == ["archive/data.warc.gz", "indexes/index.cdxj"]
    records = list(opened(data).records())
    assert [r.page_id for r in records] == list(range(5))
    assert records[2].payload.decode() == "<p>2 é</p>" and records[2].headers["warc-target-uri"] == "http://x/2 a%0A"


def test_reads_ranges_only():
    data, read = filled(200).close(), []

    def read_at(at, n):
        read.append((at, n))
        return data[at : at + n]

    package = w.Package(read_at, len(data))
    member, offset, length = list(package.ranges())[150]
    read.clear()
    raw = read_at(package.start(member) + offset, length)
    assert w.parse_record(w._plain(raw))[0].page_id == 150
    assert sum(n for _, n in read) == 30 + length


@pytest.mark.parametrize("forced", [False, True])
def test_foreign_zip_files(forced):
    plain = b"".join(w.record(i, None, b"x" * i, i, hashlib.sha1(b"x" * i).hexdigest(), None) for i in range(3))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z, z.open("archive/a.warc", "w", force_zip64=forced) as f:
        f.write(plain)
    package = opened(buffer.getvalue())
    assert [len(r.payload) for r in package.records()] == [0, 1, 2]
    gz = w.package([("archive/b.warc.gz", bytes(filled(3).data))])
    assert [r.page_id for r in opened(gz).records()] == [0, 1, 2]


def test_damaged_files():
    data = filled().close()
    for bad in (b"", b"nothing", data[:-5], data[: len(data) // 2]):
        with pytest.raises(ValueError):
            opened(bad)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc", b"a" * 1000)
    with pytest.raises(ValueError, match="compressed"):
        list(opened(buffer.getvalue()).records())
    with pytest.raises(ValueError, match="cut off"):
        w.parse_record(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")


def test_round_trip(spark, tmp_path):
    long = "\r\n\r\n<html>PK\x05\x06 é " * 200
    rows = [(1, "u", long, 0), (5, "u", long, 0), (3, None, long, 0), (5, "u", long, 0), (None, "u", long, 0), (2, "u", None, 0), (4, "", "", 0), (6, "u", "s", 0), (7, "u", "s", 0), (8, "u", "y" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    folder = str(tmp_path / "packages")
    w.write_packages(pages, folder, package_bytes=2000)
    got = w.read_packages(spark, folder).collect()
    want = []
    for i, url, html, _ in rows:
        body = (html or "").encode()
        refers = 5 if html == long and i != 5 else None
        want.append((i, url, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers else "response", refers, None if refers else body))
    assert sorted(((*r[:6], r[6] if r[6] is None else bytes(r[6])) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    w.write_packages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert w.read_packages(spark, str(tmp_path / "none")).count() == 0


INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"


def test_other_record_types():
    plain = INFO + w.record(4, None, b"body", 4, hashlib.sha1(b"body").hexdigest(), None)
    bare = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    records = list(opened(w.package([("archive/a.warc", plain + bare)])).records())
    assert [(r.kind, r.page_id, r.payload_bytes) for r in records] == [("warcinfo", None, 9), ("response", 4, 4), ("revisit", None, None)]
    assert records[0].payload_digest == hashlib.sha1(b"software:").hexdigest() and records[2].payload_digest is None


@pytest.mark.parametrize("kept", [[], [0], [2, 3], [1, 4], [4, 0, 2]])
@pytest.mark.parametrize("packed", [False, True])
def test_an_index_of_some_records_hides_none(kept, packed):
    writer = filled()
    lines = "".join(f"{writer.lines[i]}\n" for i in kept) + 'x {"filename": "other.warc.gz", "offset": "0", "length": "5"}\nx {"filename": "data.warc.gz", "offset": "5", "length": "99999999"}\n'
    index = zlib.compress(lines.encode(), wbits=31) if packed else lines.encode()
    data = w.package([("archive/data.warc.gz", bytes(writer.data)), (f"indexes/i.cdxj{'.gz' if packed else ''}", index)])
    assert sorted(r.page_id for r in opened(data).records()) == list(range(5))


def test_a_directory_without_its_zip64_field():
    data = bytearray(filled(1).close())
    at = data.find(w.CENTRAL)
    name = int.from_bytes(data[at + 28 : at + 30], "little")
    data[at + 46 + name : at + 48 + name] = b"\x09\x00"
    with pytest.raises(ValueError, match="ZIP64 field"):
        opened(bytes(data))


def test_long_records_are_walked_in_steps(monkeypatch):
    monkeypatch.setattr(w, "STEP", 512)
    bodies = [bytes([65 + i]) * (i * 700) for i in range(4)]
    plain = [w.record(i, None, b, len(b), "", None) for i, b in enumerate(bodies)]
    packed = b"".join(zlib.compress(p, wbits=31) for p in plain)
    package = w.package([("a.warc", INFO + b"".join(plain)), ("b.warc.gz", packed)])
    assert [r.payload for r in opened(package).records() if r.kind == "response"] == bodies * 2


def test_ranges_are_read_by_tasks(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(filled(40).close())
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.zip",), (None,)], "path string")
    ranges = w.record_ranges(paths)
    assert ranges.count() == 40
    read = w.read_ranges(ranges.repartition(4)).collect()
    assert sorted(r["page_id"] for r in read) == list(range(40))
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in read)
