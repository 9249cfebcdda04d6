from __future__ import annotations

import hashlib
import random

import zstandard

from noisefleet.llm import warc as w

SCHEMA = "page_id bigint, url string, html string, payload int, kept_id int"


def archive(records, dictionary=b"", packed=False):
    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
    head = w.skippable(zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary) if dictionary else b""
    return head + b"".join(c.compress(r) for r in records)


def record(block=b"hello", kind="response", **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:page:1>", "WARC-Date": w.DATE} | {k.replace("_", "-"): v for k, v in more.items()}
    return w.record_bytes([(k, v) for k, v in fields.items() if v is not None], block)


def trained():
    rng = random.Random(13)
    words = [f"word{i}" for i in range(200)]
    return zstandard.train_dictionary(2048, [" ".join(rng.choice(words) for _ in range(100)).encode() for _ in range(300)]).as_bytes()


def test_dictionary_is_taken_from_the_leading_frame():
    d = trained()
    blocks = [b"word1 word2 " * 50, b"", b"x" * 300000]
    for content in (archive([record(b) for b in blocks], d), archive([record(b) for b in blocks], d, packed=True), archive([record(b) for b in blocks])):
        got = list(w.read_archive(content))
        assert [r["payload"] for r in got] == blocks and all(r["error"] is None for r in got)
    assert list(w.read_archive(archive([record()], d)[len(w.skippable(d)):]))[0]["error"]  # without it, the frame can't be decoded


def test_what_is_wrong_is_said_and_the_rest_is_read():
    good = record()
    bad = [good.replace(b"WARC/1.1", b"HTTP/1.1"), record(WARC_Date=None), good.replace(b"Content-Length: 5", b"Content-Length: 6"),
           good.replace(b"Content-Length: 5", b"Content-Length: x"), good[:-2], record(WARC_Payload_Digest="sha1:00"), record(b"", "revisit"),
           good.replace(b"WARC-Date: ", b"WARC-Date "), b"", b"\xff\xfe\r\n\r\n"]
    got = list(w.read_archive(archive([x for b in bad for x in (b, good)])))
    assert [bool(r["error"]) for r in got] == [True, False] * len(bad)


def test_truncated_and_foreign_bytes():
    whole = archive([record(), record()])
    cut = list(w.read_archive(whole[:-3]))
    assert cut[0]["error"] is None and "truncated" in cut[1]["error"] and len(cut) == 2
    assert list(w.read_archive(b"")) == [] and list(w.read_archive(b"no archive at all"))[0]["error"]
    assert list(w.read_archive(w.skippable(b"abc")[:-1]))[0]["error"].startswith("dictionary")


def test_frame_ends_of_all_block_kinds():
    rng = random.Random(14)
    for data in (b"", b"a" * 500000, rng.randbytes(300000), b"ab" * 70000 + rng.randbytes(9)):
        for sized in (True, False):
            frame = zstandard.ZstdCompressor(write_content_size=sized, write_checksum=sized).compress(data)
            assert w.frame_end(memoryview(frame + b"rest"), 0) == len(frame)


def test_round_trip(spark):
    big, other = "<p>" + "b" * 2000, "é" * 500
    rows = [(1, "http://a/", big), (9, "http://b/", big), (4, None, big), (2, "x", "small"), (3, "x", "small"), (5, "", None), (6, "u\r\nv", ""),
            (7, "c", other), (8, "c", other), (None, "n", big), (None, "n", "only"), (10, "l", "long " * 300000)]
    got = w.round_trip(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)).collect()
    seen = sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to, r.error) for r in got), key=str)
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    last = {"<p>" + "b" * 2000: 9, other: 8}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        keeper = last.get(html)
        to = urn(keeper) if keeper is not None and keeper != i else None
        want.append((urn(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to, None))
    assert seen == sorted(want, key=str)


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i}" * (i % 50), 0, 0) for i in range(300)], SCHEMA)
    w.write_archives(pages, str(tmp_path / "a"))
    got = {r.record_id: bytes(r.payload).decode() for r in w.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {f"<urn:page:{i}>": f"<html>{i}" * (i % 50) for i in range(300)}


def test_empty_table(spark):
    assert w.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
