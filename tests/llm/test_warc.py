import base64
import gzip
import hashlib
import random

import pytest
from odd_rows import rows_of

from claimgraph.llm import warc as W

PAGES = [(5, "http://a/\r\nx é", "same"), (3, "http://b", "same"), (9, None, "same"), (7, "http://c", None), (8, "http://d", ""),
         (2, "http://e", "Grüße"), (1, "u", "x" * 30000), (3, "http://b", "same"), (None, "n", "same"), (None, "n", "alone")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark):
    rows = [(p, u, h, "clash", 1) for p, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, first int").repartition(3)


def want():
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h in PAGES:
        revisit = first.get(h or "", p) != p
        out.append((p, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    assert rows_of(W.round_trip(pages(spark))) == want()
    assert rows_of(W.round_trip(pages(spark).where("page_id = -1"))) == []


def test_small_payloads_may_stay_responses(spark):
    got = {(r[0], r[3]) for r in rows_of(W.round_trip(pages(spark), least_bytes=1))}
    assert (7, "response") in got and (8, "response") in got and (9, "revisit") in got


def test_files_are_plain_members(spark, tmp_path):
    files = [r["file"] for r in W.write(pages(spark), str(tmp_path)).collect()]
    assert files and all(gzip.decompress(open(f, "rb").read()).startswith(b"WARC/1.1\r\n") for f in files)


def test_files_roll_and_carry_payloads(spark, tmp_path):
    manifest = W.write(pages(spark), str(tmp_path), roll_bytes=300)
    assert manifest.count() > 3
    got = W.read(manifest)
    blocks = {r["page_id"]: bytes(r["block"]) for r in got.where("record_type = 'response'").collect()}
    assert blocks[1].endswith(b"\r\n\r\n" + b"x" * 30000) and blocks[2].endswith("Grüße".encode())
    assert "\r" not in (got.where("page_id = 5").first()["uri"])


def archive(zipped=True):
    raws = [W.record(k, f"http://x/{k}", f"page {k} ".encode() * 20, digest(f"page {k} " * 20), None) for k in range(6)]
    return [W.member(r) if zipped else r for r in raws]


def ids(found):
    return [f.headers.get("warc-record-id") if f.problem is None else None for f in found]


@pytest.mark.parametrize("zipped", [True, False])
def test_every_damage_is_survived(zipped):
    parts = archive(zipped)
    data, draw = b"".join(parts), random.Random(1)
    assert ids(W.salvage(data)) == [W.name(k) for k in range(6)]
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    for _ in range(60):
        at, n = draw.randrange(len(data)), draw.randrange(1, 40)
        broken = data[:at] + bytes(b ^ 0x55 for b in data[at:at + n]) + data[at + n:]
        found = list(W.salvage(broken))
        hurt = {k for k in range(6) if starts[k] < at + n and at < starts[k + 1]}
        got = {f.headers.get("warc-record-id") for f in found if f.problem is None}
        assert {W.name(k) for k in range(6) if k not in hurt} <= got
        # Records and gaps tile the file.
        assert [f.offset for f in found[1:]] == [f.offset + f.length for f in found[:-1]] and found[0].offset == 0
        assert found[-1].offset + found[-1].length == len(broken)


def test_gaps_are_logged():
    parts = archive()
    found = list(W.salvage(parts[0] + b"garbage" + parts[1] + parts[2][:50] + parts[3] + parts[4][:-9]))
    # The last member breaks off behind its record, whose block digest still agrees.
    assert ids(found) == [W.name(0), None, W.name(1), None, W.name(3), W.name(4), None]
    assert found[1].length == 7 and found[1].problem == "no version line"
    assert found[3].length == 50 and found[6].length == len(parts[4]) - 9
    assert list(W.salvage(b"")) == [] and ids(W.salvage(b"junk")) == [None]


def test_a_member_must_hold_a_whole_record():
    raw = gzip.decompress(archive()[0])
    for bad in (raw[:-4], raw.replace(b"page 0", b"page 9", 1), raw.replace(b"Content-Length: ", b"Content-Size: ", 9)):
        assert ids(W.salvage(W.member(bad) + archive()[1])) == [None, W.name(1)]


def test_records_inside_members():
    raws, after = archive(zipped=False), archive()[5]
    many = W.member(b"".join(raws[:3]))
    found = list(W.salvage(many + after))
    assert ids(found) == [W.name(0), W.name(1), W.name(2), W.name(5)]
    assert [f.inner for f in found] == [0, len(raws[0]), len(raws[0] + raws[1]), None]
    assert [(f.offset, f.length) for f in found] == [(0, 0), (0, 0), (0, len(many)), (len(many), len(after))]
    found = list(W.salvage(W.member(raws[0] + b"x") + after))
    assert ids(found) == [W.name(0), None, W.name(5)] and (found[1].inner, found[1].problem) == (len(raws[0]), "no version line")
    found = list(W.salvage(W.member(raws[0] + raws[1][:-9] + raws[2]) + after))
    assert ids(found) == [W.name(0), None, W.name(2), W.name(5)]


@pytest.mark.parametrize("stored", [False, True])
def test_records_of_broken_members(stored):
    draw = random.Random(4)
    blocks = [bytes(draw.randrange(256) for _ in range(900)) for _ in range(3)]
    raws, after = [W.record(k, None, b, W.base32_sha1(b), None) for k, b in enumerate(blocks)], archive()[5]
    many = gzip.compress(b"".join(raws), 0) if stored else W.member(b"".join(raws))
    flipped = many[:-6] + bytes([many[-6] ^ 1]) + many[-5:]
    hurt = many[:1500] + bytes(b ^ 0x55 for b in many[1500:1510]) + many[1510:]
    for broken, want in ((many[:-9], {0, 1}), (flipped, {0, 1, 2}), (hurt, {0})):
        found = list(W.salvage(broken + after))
        got = [f.headers["warc-record-id"] for f in found if f.problem is None]
        assert len(got) == len(set(got)) and {W.name(k) for k in want} <= set(got) and got[-1] == W.name(5)
        assert [f.offset for f in found[1:]] == [f.offset + f.length for f in found[:-1]] and found[0].offset == 0
        assert any(f.problem for f in found) and found[-1].offset + found[-1].length == len(broken + after)
        assert all(f.block.endswith(blocks[int(f.headers["warc-record-id"][10:-1])]) for f in found[:-1] if f.problem is None)
    assert list(W.read_at(many, 0))[-1].length == len(many)


def test_quarantine_of_a_damaged_file(spark, tmp_path):
    parts = archive()
    (tmp_path / "bad.warc.gz").write_bytes(parts[0] + parts[1][:30] + b"\0" * 40 + parts[2])
    got = W.read(spark.createDataFrame([(str(tmp_path / "bad.warc.gz"),)], "file string"), with_block=False)
    assert [r["page_id"] for r in got.where("problem is null").orderBy("offset").collect()] == [0, 2]
    gap = got.where("problem is not null").first()
    assert (gap["offset"], gap["length"]) == (len(parts[0]), 70)
