from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import Counter

import pytest

from catalogspark.llm import warc
from catalogspark.llm.frames import new_path

PAGES = "page_id long, url string, html string, shard int, key string, hash long, payload string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    """Plain reading of the contract: rows in order, the first of each payload answers."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    first, out = {}, Counter()
    for page, _, html in order:
        text = html or ""
        size = len(text.encode())
        if size >= least and text in first:
            out[page, size, digest(text), "revisit", first[text]] += 1
        else:
            first.setdefault(text, page)
            out[page, size, digest(text), "response", None] += 1
    return out


ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u v\né", ""), (5, "http://c/", "ünï " * 5000),
    (7, "http://d/", "x"), (7, "http://d/", "x"), (7, "http://e/", "y"), (None, "http://f/", "same"), (None, None, None),
    (None, "http://g/", "alone"), (None, "http://g/", "alone"), (-3, "http://h/", "late"), (9, "http://i/", "late"),
    *[(100 + i, f"http://hot/{i}", "hot") for i in range(300)], *[(500, f"http://one/{i}", f"t{i}") for i in range(200)],
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "k", 2, "p") for r in ROWS], PAGES).repartition(5)


def got(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("least", [0, 4])
def test_records(spark, pages, least):
    folder = new_path(spark, "warc")
    manifest = warc.write_warc(pages, folder, shard_bytes=20_000, file_bytes=2_000, least_payload=least).collect()
    found = warc.read_warc(spark, folder)
    assert got(found) == expected(ROWS, least)
    payloads = Counter((r.page_id, r.payload.decode()) for r in found.collect() if r.record_type == "response")
    assert all(digest(text) for _, text in payloads) and sum(payloads.values()) == sum(
        n for row, n in expected(ROWS, least).items() if row[3] == "response"
    )
    assert sum(r.n_records for r in manifest) == len(ROWS)
    assert len({r.shard for r in manifest}) > 3 and max(r.number for r in manifest) > 0  # files are rolled
    assert all(r.n_bytes < 2_000 + 2_000 for r in manifest)
    local = folder.removeprefix("file:")
    assert sorted(f for f in os.listdir(local) if f.endswith(".gz")) == sorted(r.name for r in manifest)
    assert not os.path.exists(f"{local}/_temporary")


def test_same_files_for_any_order(spark, pages):
    def files(df):
        rows = warc.write_warc(df, new_path(spark, "warc"), shard_bytes=20_000, file_bytes=5_000).collect()
        return sorted((r.name, r.sha256, r.n_records) for r in rows)

    assert files(pages) == files(pages.repartition(2).orderBy("url"))


def test_file_format(spark, pages):
    folder = new_path(spark, "warc")
    name = warc.write_warc(pages, folder).first().name
    with open(f"{folder.removeprefix('file:')}/{name}", "rb") as file:
        data = file.read()
    kinds = Counter()
    while data:
        one = zlib.decompressobj(31)
        member = one.decompress(data)
        data = one.unused_data
        headers, block = warc.parse_record(member)
        kinds[headers["warc-type"]] += 1
        assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
        assert headers["warc-record-id"].startswith("<urn:uuid:") and "warc-date" in headers
        if headers["warc-type"] == "revisit":
            assert headers["warc-profile"] == warc.PROFILE and headers["warc-refers-to"] and block.endswith(b"\r\n\r\n")
    assert kinds["warcinfo"] == 1 and kinds["response"]


def test_broken_archive_is_refused(spark, pages):
    folder = new_path(spark, "warc")
    row = warc.write_warc(pages, folder).orderBy("name").first()
    path = f"{folder.removeprefix('file:')}/{row.name}"
    with open(path, "rb") as file:
        data = file.read()
    with open(path, "wb") as file:
        file.write(data[:-40])
    with pytest.raises(Exception, match="cut off|records"):
        warc.read_warc(spark, folder).collect()


def test_empty(spark):
    folder = new_path(spark, "warc")
    assert warc.write_warc(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read_warc(spark, folder).count() == 0
    assert warc.read_warc(spark, folder, payloads=False).columns[-1] == "refers_to"
