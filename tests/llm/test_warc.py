import hashlib
import random
import re

import pytest

from surgeline.llm import warc as W


def want(rows, least=1000):
    """(id, type, refers_to, bytes, digest) of rows (id, url, text)."""
    out, last = [], {}
    for i, _, t in rows:
        raw = (t or "").encode()
        if len(raw) >= least and i is not None:
            last[raw] = max(last.get(raw, i), i)
    for i, _, t in rows:
        raw = (t or "").encode()
        to = last.get(raw)
        again = to is not None and i != to
        out.append((i, "revisit" if again else "response", to if again else None, len(raw), hashlib.sha1(raw).hexdigest()))
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1:2], x[4]))


def got(df):
    return sorted([(r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()], key=lambda x: (x[0] is None, x[0] or 0, x[1:2], x[4]))


def chain(raw):
    """(offset, header, block) of a file by walking it from its start."""
    out, at = [], 0
    while at < len(raw):
        assert raw.startswith(W.MAGIC.encode(), at)
        end = raw.index(b"\r\n\r\n", at)
        n = int(re.search(rb"\r\nContent-Length: (\d+)", raw[at:end])[1])
        assert raw[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        out.append((at, raw[at + len(W.MAGIC) : end].decode(), raw[end + 4 : end + 4 + n]))
        at = end + 8 + n
    return out


@pytest.fixture
def small_parts(spark):
    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def sample(seed, n=20):
    r = random.Random(seed)
    fake = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {k}\r\n\r\nabc"
    bits = ["word ", "é𝄞", "\r\n\r\n", "WARC/1.0\r\n", "WARC/1.", "\r\n", "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n", "Content-Length: 5\r\n\r\n", fake(3), fake(40), fake(400), "\n", "W"]
    texts = ["".join(r.choice(bits) for _ in range(r.choice((0, 1, 5, 40, 150)))) for _ in range(n)]
    rows = [(i, r.choice((None, "http://a.example/x", "http://a.example/ü\r\nContent-Length: 7")), t) for i, t in enumerate(texts)]
    big = "WARC/1.0\r\n" * 400
    rows += [(500 + i, "u", big) for i in range(5)] + [(900, None, None), (901, "", ""), (902, "u", "same" * 10), (903, "u", "same" * 10), (903, "v", "same" * 300), (904, "v", "same" * 300), (904, "v", "same" * 300), (None, "x", "same" * 300), (None, "y", "z" * 1500), (None, "y", "z" * 1500)]
    return rows


@pytest.mark.parametrize("part", [1500, 9000, 1 << 27])
def test_records_come_back_wherever_files_are_split(spark, tmp_path, small_parts, part):
    rows = sample(part)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as digest", "2 as size").repartition(3)
    path = "file://" + str(tmp_path / "a")
    W.write_archives(df, path)
    small_parts(part)
    back = W.read_archives(spark, path)
    files = sorted((tmp_path / "a").glob("part-*"))
    brute = sorted((str(f), *x) for f in files for x in chain(f.read_bytes()))
    assert sorted((re.sub("^file:(//)?", "", r.path), r.offset, r.header, bytes(r.block)) for r in back.collect()) == brute
    out = W.payloads(back)
    assert got(out) == want(rows)
    texts = sorted((t or "") for _, _, t in rows)
    held = {r.payload_digest: bytes(r.payload).decode() for r in out.where("record_type = 'response'").collect()}
    assert sorted(held[r.payload_digest] for r in out.collect()) == texts
    assert {r.url for r in out.collect()} <= {None, "u", "v", "x", "y", "http://a.example/x", "http://a.example/ü%0D%0AContent-Length:%207"}


def test_shuffled_parts_give_the_same(spark, tmp_path, small_parts, monkeypatch):
    rows = sample(1)
    path = "file://" + str(tmp_path / "a")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    small_parts(2500)
    monkeypatch.setattr(W, "PARTS", 1)
    assert got(W.payloads(W.read_archives(spark, path))) == want(rows)


def test_many_parts_take_few_rounds(spark, tmp_path, small_parts, monkeypatch):
    path = "file://" + str(tmp_path / "a")
    W.write_archives(spark.range(40).selectExpr("id as page_id", "'u' as url", "repeat('abc ', 50) as html").coalesce(1), path)
    small_parts(600)
    made = []
    real = W.reached_from
    monkeypatch.setattr(W, "reached_from", lambda start, jumps, scratch: (made.append(jumps.count()), real(start, jumps, scratch))[1])
    assert W.read_archives(spark, path).count() == 40 and made[0] > 12


def test_a_file_that_is_cut_short_is_an_error(spark, tmp_path, small_parts):
    path = tmp_path / "a"
    W.write_archives(spark.createDataFrame(sample(2), "page_id long, url string, html string").coalesce(1), "file://" + str(path))
    file = next(path.glob("part-*"))
    raw = file.read_bytes()
    for part in (9000, 1 << 27):
        small_parts(part)
        for bad in (raw[:-50], raw[10:], b"x" + raw, raw + b"y", b"no archive"):
            (tmp_path / "bad").mkdir(exist_ok=True)
            (tmp_path / "bad" / "b.warc").write_bytes(bad)
            with pytest.raises(ValueError, match="b.warc is not a chain"):
                W.read_archives(spark, "file://" + str(tmp_path / "bad"))


def test_empty_table_and_other_ids(spark, tmp_path):
    path = "file://" + str(tmp_path / "a")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_archives(spark, path).count() == 0
    path = "file://" + str(tmp_path / "b")
    W.write_archives(spark.createDataFrame([("a b>\r\n", "u", "x"), ("é", None, "")], "page_id string, url string, html string"), path)
    assert {r.id for r in W.payloads(W.read_archives(spark, path), "string").collect()} == {"a b>\r\n", "é"}


def test_payloads_of_any_bytes(spark, tmp_path):
    raw = bytes(range(256)) * 5
    head = f"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length:  {len(raw)} \r\n\r\n".encode()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes((head + raw + b"\r\n\r\n") * 3)
    assert [bytes(r.block) for r in W.read_archives(spark, "file://" + str(tmp_path / "a")).collect()] == [raw] * 3
