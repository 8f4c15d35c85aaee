"""Archives: round trips through both formats and the rule for revisits, against brute force."""

import gzip
import hashlib

import pytest

from corpuslab.llm import archives

ROWS = [
    (5, "http://a.example/x", "<html>" + "é" * 100), (3, "http://b.example/y?q=1#z", "<html>" + "é" * 100), (9, None, "<html>" + "é" * 100),
    (1, "http://c.example/with space\nline", "short"), (2, "x", "short"), (4, "", None), (6, "u", ""),
    (7, "v", "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9), (8, "w", "http://a 1.1.1.1 20200101000000 text/html 7\nfiledesc://\n" * 9),
    (10, "z", "y" * 99), (11, "z", "y" * 99), (12, "z", "y" * 100), (13, "z", "y" * 100), (13, "z", "y" * 100), (12, "z", "y" * 100),
    (14, "\u0000", "\u0000\u0001 nul"), (15, "big", "word " * 200_000),
]


def brute(rows):
    least, out = {}, []
    for key, _, page in rows:
        raw = (page or "").encode()
        if len(raw) >= 100:
            least[raw] = min(least.get(raw, key), key)
    for key, _, page in rows:
        raw = (page or "").encode()
        first = least.get(raw, key)
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == key else "revisit", None if first == key else first))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


@pytest.mark.parametrize("per_file", [1024, 2])
def test_round_trip(spark, monkeypatch, per_file):
    monkeypatch.setattr(archives, "PER_FILE", per_file)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    assert result(archives.archive(pages)) == brute(ROWS)


def test_empty_table_and_null_ids(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archive(pages).count() == 0
    text = "t" * 200
    pages = spark.createDataFrame([(None, "a", text), (None, "b", text)], "page_id long, url string, html string")
    assert [(r.page_id, r.record_type, r.refers_to) for r in archives.archive(pages).collect()] == [(None, "response", None)] * 2


def test_both_arc_versions_by_declared_length():
    for version in (1, 2):
        fields = "a b 192.0.2.1 20240102030405 text/html" + (" 200 - - 0 f.arc" if version == 2 else "")
        content = b"x\ny z 1.2.3.4 20200101000000 text/html 3\nabc"
        data = archives._version_block(version).encode() + fields.encode() + b" %d\n" % len(content) + content + b"\n"
        data += b"u 192.0.2.1 20240102030405 text/html" + (b" 200 - - 0 f.arc" if version == 2 else b"") + b" 0\n\n"
        records = list(archives.parse_arc(data))
        assert [c for _, c in records] == [content, b""]
        assert records[0][0]["URL"] == "a b" and records[0][0]["Archive-date"] == "20240102030405"
        with pytest.raises(ValueError):
            list(archives.parse_arc(data[:-20].replace(b"text/html %d\n" % len(content), b"text/html 99999\n") if version == 1 else data[: len(data) // 2]))


def test_files_are_plain_archives(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:4], "page_id long, url string, html string").coalesce(1)
    archives.write_arc(pages, f"{tmp_path}/arc")
    archives.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    (arc,) = (tmp_path / "arc").glob("*.gz")
    assert gzip.decompress(arc.read_bytes()).startswith(b"filedesc://pages-v1.arc 0.0.0.0 20240101000000 text/plain")
    records = [r for f in (tmp_path / "warc").glob("*.gz") for r in archives.parse_warc(gzip.decompress(f.read_bytes()))]
    by_type = [h["warc-type"] for h, _ in records]
    assert by_type.count("response") == 2 and by_type.count("revisit") == 2 and "warcinfo" in by_type
    ids = {h["warc-record-id"] for h, _ in records if h["warc-type"] == "response"}
    for header, block in records:
        assert header["warc-date"] == "2024-01-01T00:00:00Z"
        if header["warc-type"] == "revisit":
            assert header["warc-refers-to"] in ids and block.endswith(b"\r\n\r\n")
