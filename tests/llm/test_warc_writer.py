import hashlib
import json

import pytest

from ledgerlake.llm.warc_writer import archive_and_read, member, parse, read_archive, record, write_archive

SCHEMA = "page_id long, url string, html string, digest string, size int"


def rows():
    big = "é" * 600
    r = [(k, f"http://x/{k}", f"<p>{k % 9}</p>" * 30 * (k % 9), "d", 1) for k in range(120)]
    r += [(500 + k, None, big, "d", 1) for k in range(5)] + [(504, "again", big, "d", 1), (None, "n", big, "d", 1)]
    return r + [(600, "u\r\nX-Bad: 1", None, "d", 1), (601, "u", "", "d", 1), (602, "u", "x" * 999, "d", 1), (603, "u", "x" * 999, "d", 1), (604, "u", "y" * 1000, "d", 1), (605, "u", "y" * 1000, "d", 1), (None, "n", "z" * 2000, "d", 1), (None, "n", "z" * 2000, "d", 1)]


def brute(rows):
    best = {}
    for i, _, t, *_ in rows:
        if t and len(t.encode()) >= 1000 and i is not None:
            best[t] = max(best.get(t, i), i)
    out = []
    for i, _, t, *_ in rows:
        b = (t or "").encode()
        to = best.get(t) if len(b) >= 1000 else None
        revisit = to is not None and to != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 5000, "roll_bytes": 700}])
def test_round_trip(spark, kw):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted((tuple(r) for r in archive_and_read(df, **kw).collect()), key=str) == brute(rows())


def test_files_repeat_and_hold_the_pages(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    first = write_archive(df, a, shard_bytes=5000, roll_bytes=700)
    assert first == write_archive(df.repartition(7), b, shard_bytes=5000, roll_bytes=700)
    assert first == json.loads((tmp_path / "a/manifest.json").read_text()) and len(first["files"]) > 5
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == sorted([*(x["file"] for x in first["files"]), "manifest.json"])
    html = {(r.page_id, r.html) for r in read_archive(spark, a).filter("record_type = 'response'").collect()}
    assert (604, None) not in html and (605, "y" * 1000) in html and (600, "") in html
    (tmp_path / "a" / first["files"][0]["file"]).write_bytes(b"other")
    with pytest.raises(Exception):
        read_archive(spark, a).collect()


def test_empty(spark):
    assert archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_record_parts():
    big = record(1, "u", b"p" * 300_000, 300_000, hashlib.sha1(b"p" * 300_000).hexdigest(), None, 0, "d")
    data = member(big) + member(record(2, "u", b"", 5, "00" * 20, 1, 0, "d"))
    (h, block), (g, rest) = parse(data)
    assert block.endswith(b"p" * 300_000) and g["WARC-Type"] == "revisit" and g["X-Refers-To-Page"] == "1" and rest.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(parse(data[:-3]))


def test_borders_of_skewed_ids(spark):
    """Ids in two far clusters: no shard but one of a single id holds more than its bytes."""
    from ledgerlake.llm.warc_writer import _borders

    ids = [-(2**63), *range(1000, 1400), 2**62, 2**63 - 1]
    size = {i: 400 + i % 7 * 100 for i in ids} | {1100: 50_000}
    df = spark.createDataFrame(list(size.items()), "page_id long, size long")
    borders = _borders(df, 10_000)
    assert borders == sorted(set(borders))
    shards = {}
    for i in ids:
        shards.setdefault(sum(b <= i for b in borders), []).append(i)
    assert len(shards) > 20 and all(len(s) == 1 or sum(size[i] + 600 for i in s) <= 10_000 for s in shards.values())
