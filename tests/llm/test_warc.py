import hashlib
import random

import pytest

from hyperloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def archive(n=6):
    return [warc.record(i, f"http://x/{i}", f"page {i} ".encode() * 50, None) for i in range(n)]


def ids_of(items, sound=(True,)):
    return [int(r[4]["warc-record-id"][10:-1]) for r in items if r[0] == "record" and r[6] in sound]


def found(raw, sound=(True,)):
    """Ids and gaps; members and gaps between them cover the archive."""
    items, at, held = list(warc.salvage(raw)), 0, 0
    for x in items:
        if x[0] == "record" or x[3] is None:
            assert x[1] == at or x[0] == "record" and x[1] == held  # records of one member share its place
            held, at = (x[1], x[1] + x[2]) if x[0] == "record" else (held, x[1] + x[2])
    assert at == len(raw) or items[-1][3] is not None
    return ids_of(items, sound), [x for x in items if x[0] == "gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in archive()]
    assert found(b"".join(parts)) == (list(range(6)), [])
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 255
    ids, gaps = found(b"".join([*parts[:2], bytes(bad), *parts[3:]]))
    start, end = len(parts[0]) + len(parts[1]), sum(map(len, parts[:3]))
    assert ids == [0, 1, 3, 4, 5] and len(gaps) == 1 and start <= gaps[0][1] <= gaps[0][1] + gaps[0][2] == end
    ids, gaps = found(b"".join([parts[0], b"junk\x1f\x8b\x08junk", *parts[1:]]))
    assert ids == list(range(6)) and len(gaps) >= 1 and sum(g[2] for g in gaps) == 11
    ids, gaps = found(b"".join(parts)[:-20])
    assert ids == list(range(5)) and len(gaps) == 1
    ids, gaps = found(b"".join(parts)[10:])
    assert ids == list(range(1, 6)) and len(gaps) == 1


def test_records_after_a_damaged_one_of_the_same_member():
    some = archive()
    some[2] = some[2].replace(b"page 2 page", b"page 2 PAGE", 1)
    ids, gaps = found(warc.member(b"".join(some)))
    assert ids == [0, 1, 3, 4, 5] and [(g[2], g[3]) for g in gaps] == [(len(some[2]), len(some[0]) + len(some[1]))]


def test_what_inflates_before_the_damage_is_kept():
    rng = random.Random(1)
    some = [warc.record(i, "u", rng.randbytes(3000), None) for i in range(40)]
    whole = warc.member(b"".join(some))
    every = (True, False)
    ids, gaps = found(whole[: len(whole) // 2] + warc.member(archive(50)[49]), every)
    assert ids[:-1] == list(range(len(ids) - 1)) and len(ids) >= 19 and ids[-1] == 49 and len(gaps) == 1
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 255
    ids, gaps = found(bytes(hurt) + warc.member(archive(50)[49]), every)
    assert found(bytes(hurt) + warc.member(archive(50)[49]))[0] == [49]
    assert ids[0] == 0 and ids[-1] == 49 and 39 <= len(ids) <= 41 and gaps


def test_both_kinds_of_start_in_one_archive():
    some = archive()
    mixed = b"xx\x1f\x8b\x08" + some[0][30:] + some[1] + warc.member(some[2]) + b"WARC/9" + some[3] + warc.member(some[4])[:60] + some[5]
    ids, gaps = found(mixed)
    assert ids == [1, 2, 3, 5] and len(gaps) == 3


def test_random_damage_of_members_of_several_records():
    rng = random.Random(8)
    some = [warc.record(i, f"http://x/{i}", rng.randbytes(rng.randrange(400)) + f"page {i} ".encode() * rng.randrange(80), None) for i in range(40)]
    for packed in (True, False):
        for _ in range(30):
            parts = [b"".join(some[i : i + 5]) for i in range(0, 40, 5)]
            parts = [warc.member(x) for x in parts] if packed else parts
            k = rng.randrange(8)
            hurt = bytearray(parts[k])
            for _ in range(rng.randrange(1, 4)):
                hurt[rng.randrange(len(hurt))] ^= 1 + rng.randrange(255)
            if rng.random() < 0.3:
                hurt = hurt[: rng.randrange(len(hurt))]
            ids, gaps = found(b"".join([*parts[:k], bytes(hurt), *parts[k + 1 :]]))
            assert gaps or not packed or ids == list(range(40))
            assert [i for i in ids if i // 5 != k] == [i for i in range(40) if i // 5 != k]
            for x in warc.salvage(b"".join([*parts[:k], bytes(hurt), *parts[k + 1 :]])):
                if x[0] == "record":
                    assert warc.sha1_of(x[4].get("warc-block-digest")) in (None, hashlib.sha1(x[5]).hexdigest())


def test_foreign_digests_and_records():
    def foreign(kind, digest, block=b"", more=()):
        lines = [f"WARC-Type: {kind}", *([f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {digest}"] if digest else []), *more, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    right = hashlib.sha1(b"abc").hexdigest()
    raw = [foreign("resource", f"sha1:{right}", b"abc"), foreign("revisit", "sha1:A9993E", b""), foreign("resource", "md5:900150983cd24fb0d6963f7d28e17f72", b"abc"), foreign("revisit", "sha1:notbase32!", b""), foreign("warcinfo", None, b"x: y")]
    got = [warc._row("a", *x[1:]) for x in warc.salvage(b"".join(raw)) if x[0] == "record"]
    assert [r[4] for r in got] == ["resource", "revisit", "resource", "revisit", "warcinfo"]
    assert got[0][8:11] == (b"abc", 3, right) and got[1][8:11] == (None, None, None) and got[4][8] == b"x: y"
    assert warc.sha1_of("SHA1:" + right.upper()) == right and warc.sha1_of(None) is None and warc.sha1_of("sha1:") is None
    wrong = foreign("resource", "sha1:" + "0" * 40, b"abc")
    assert [x[0] for x in warc.salvage(wrong)] == ["gap"]


def test_salvage_of_random_damage():
    rng = random.Random(3)
    parts = [warc.member(r) for r in archive(20)]
    starts = [sum(map(len, parts[:i])) for i in range(21)]
    raw = bytearray(b"".join(parts))
    hit = set()
    for _ in range(5):
        at = rng.randrange(len(raw))
        k = max(i for i in range(20) if starts[i] <= at)
        if at - starts[k] > 12:
            raw[at] ^= 1 + rng.randrange(255)
            hit.add(k)
    ids, _ = found(bytes(raw))
    assert ids == [i for i in range(20) if i not in hit]


def test_empty_and_junk():
    assert found(b"") == ([], [])
    ids, gaps = found(b"nothing here")
    assert ids == [] and len(gaps) == 1
    ids, gaps = found(warc.member(b"not a record") + warc.member(archive(1)[0]))
    assert ids == [0] and len(gaps) == 1


def test_round_trip(spark, clashing):
    big, other = "x" * 1500, "é" * 600
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", other), (9, "u", other), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (None, "u", big), (11, "u", "y" * 3_000_000)]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.round_trip(clashing(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = set()
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if x == h and j is not None]
        head = max(same) if len(raw) >= 1000 and i is not None else i
        want.add((i, "response" if head == i else "revisit", None if head == i else head, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_payloads_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    df = spark.createDataFrame([(i % 30, "u", f"text {i % 30} " * 40) for i in range(60)], SCHEMA)
    path = f"file://{tmp_path}/w"
    archives = warc.write(df, path)
    written = archives.collect()
    assert len({r["archive"] for r in written}) == len(written) > 1 and sum(r["records"] for r in written) == 60
    stale = tmp_path / "w" / "part-000000-lost"
    stale.mkdir()
    (stale / "0000.warc.gz").write_bytes(warc.member(archive(1)[0]))  # an attempt that was lost
    back = warc.read(spark, path, archives=archives)
    assert sorted((r["page_id"], r["payload"].decode()) for r in back.collect()) == sorted((i % 30, f"text {i % 30} " * 40) for i in range(60))
    assert warc.gaps(spark, path, archives=archives).count() == 0 and warc.read(spark, path).count() == 61
    name = f"{tmp_path}/w/{written[0]['archive']}"
    raw = bytearray(open(name, "rb").read())
    raw[30] ^= 255
    open(name, "wb").write(raw)
    assert warc.read(spark, path, archives=archives).where("sound").count() == 59
    assert [r["inside"] for r in warc.gaps(spark, path).collect()] == [None]
    assert warc.read(spark, path).where("sound").count() == 60


def test_one_payload_of_very_many_pages(spark):
    df = spark.createDataFrame([(i, "u", "same " * 300) for i in range(2000)] + [(3000 + i, "u", f"own {i} " * 200) for i in range(50)], SCHEMA)
    got = warc.round_trip(df).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 51, "revisit": 1999}


def test_ids_and_lengths_of_64_bits(spark):
    big = (1 << 63) - 1
    rows = [(i, "u", "x" * 2000) for i in (big, big - 1, 10**18, -(1 << 63), -1, 0)] + [(big - 2, None, "y"), (None, "u", "z" * 1500)]
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == {r[0] for r in rows}
    assert [got[i]["refers_to"] for i in (big, big - 1, 10**18, -(1 << 63), -1, 0)] == [None, *[big] * 5]
    assert warc._long("9223372036854775808") is None and warc._long("-9223372036854775809") is None and warc._long("") is None and warc._long("9" * 5000) is None
    assert warc._long(str(big)) == big and warc._long(str(-(1 << 63))) == -(1 << 63)


def test_headers_that_go_on_in_the_next_line():
    raw = warc.record(3, "http://x/a", b"payload", None).replace(b"WARC-Target-URI: http://x/a", b"WARC-Target-URI: http://x/a\r\n  and on\r\n\tand on")
    headers, _, end = warc.parse(raw)
    assert headers["warc-target-uri"] == "http://x/a and on and on" and end == len(raw)
    assert found(raw + archive(1)[0]) == ([3, 0], [])
    assert found(raw.replace(b"WARC/1.1\r\n", b"WARC/1.1\r\n folded first\r\n") + archive(1)[0])[0] == [0]
