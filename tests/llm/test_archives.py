"""WARC bundles: round trips, the seekable format, copies and odd pages."""

import base64
import hashlib
import random

import pytest
import zstandard

from schemaloom.llm import warc

SCHEMA = "page_id long, url string, html string, verified string"


def make_pages(n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        html = "copied " * 40 if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n" + "".join(rng.choices("abcé日 \n", k=rng.randint(0, 500)))
        rows.append((i, f"http://h.example/{i}?a b\né" if i % 7 else None, html, "clash"))
    return rows + [(7, "u", "twice", None), (7, "u", "twice", None), (None, "v", "twice", None), (None, "w", "alone", None), (1000, "x", "long " * 300_000, None)]


def wanted(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by definition."""
    first, out = {}, []
    for page, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if len(body) >= least and body in first:
            out.append((page, len(body), digest, "revisit", first[body]))
        else:
            first[body] = page
            out.append((page, len(body), digest, "response", None))
    return out


def found(archive):
    rows = warc.read(archive, payload=False).collect()
    assert all(r.verified for r in rows)
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]


@pytest.mark.parametrize("least", [0, 6, 281])
def test_records_come_back(spark, least):
    rows = make_pages()
    archive = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(5), least_bytes=least, frame_bytes=4000, bundle_bytes=40_000)
    assert sorted(found(archive), key=str) == sorted(wanted(rows, least), key=str)


def test_bundles_are_seekable_files(spark, tmp_path):
    rows = make_pages(200)
    archive = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(2), frame_bytes=4000, bundle_bytes=40_000)
    places = warc.record_map(archive).collect()
    assert len({p.record_id for p in places}) == len(rows)
    bundles = {p.bundle for p in places}
    assert len(bundles) > 2
    html = {r[0]: r[2] or "" for r in rows if r[0] is not None}
    for name in bundles:
        warc.export(archive, name, str(tmp_path / name))
        data = (tmp_path / name).read_bytes()
        table = warc.read_seek_table(data)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # the seek table is skipped
        assert len(whole) == sum(raw for _, _, raw in table)
        starts = [sum(raw for _, _, raw in table[:k]) for k in range(len(table))]
        for p in [p for p in places if p.bundle == name]:
            record = warc.read_at(data, p.frame, p.offset, p.length)
            assert record == whole[starts[p.frame] + p.offset:starts[p.frame] + p.offset + p.length]
            fields, body, end = warc.parse_record(record)
            assert (fields["record_id"], end) == (p.record_id, len(record))
            if fields["record_type"] == "response" and p.page_id not in (None, 7):  # 7 stands for three pages
                assert body.decode() == html[p.page_id]


def test_lookup_reads_pages_and_what_they_refer_to(spark):
    rows = [(i, "u", "same" if i % 2 else f"own {i}", None) for i in range(60)]
    archive = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), frame_bytes=1000)
    got = {r.page_id: (r.record_type, r.payload.decode(), r.refers_to) for r in warc.lookup(archive, spark.createDataFrame([(1,), (5,), (6,), (5,), (999,)], "page_id long")).collect()}
    assert got == {1: ("response", "same", None), 5: ("revisit", "same", 1), 6: ("response", "own 6", None)}


def test_damage_is_noticed():
    data = warc.make_record("urn:uuid:x", "1", None, warc.digest32(b"text"), 4, b"text")
    assert warc.parse_record(data)[0]["verified"]
    assert not warc.parse_record(data.replace(b"text\r\n", b"tExt\r\n"))[0]["verified"]
    with pytest.raises(ValueError):
        warc.parse_record(data[:-2])
    with pytest.raises(ValueError):
        warc.read_seek_table(b"x" * 40)


def test_empty_table_and_text_ids(spark):
    assert found(warc.write(spark.createDataFrame([], SCHEMA))) == []
    rows = [("a b", "u", "x", None), ("é\r\n", "u", "x", None)]
    archive = warc.write(spark.createDataFrame(rows, SCHEMA.replace("page_id long", "page_id string")))
    assert sorted((r.record_type, r.payload_bytes) for r in warc.read(archive).collect()) == [("response", 1), ("revisit", 1)]
