"""Merkle manifest, WARC archives and source divergence against loops: nulls, empty and long texts, ties, repeats, odd columns."""

import collections
import gzip
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from odflow.llm import divergence, merkle, packing, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(i, rng.choice([None, "", "a\nb", "x" * i, "é\n"]), rng.choice(["en", None]), rng.choice([None, "", "s1", "s2", "é"]) if i % 3 else "s1", rng.choice([None, 3])) for i in range(150)]
    return out + [(7, "dup", "en", "s1", 1)] * 3 + [(None, "q", "en", "s1", 1), (None, None, None, None, None), (5000, "z" * 100_000, "de", "lone", 2)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = {"rank": F.lit(1), "block": F.lit("b"), "hash": F.lit(None).cast("string"), "term": F.lit(2), "n": F.lit(3)}
    return spark.createDataFrame(rows, DOCS).withColumns(extra).repartition(3).cache()


def tree(nodes):
    """Top and, for each node, its (left, right) siblings level by level."""
    paths, member, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, m in enumerate(member):
            g = m // 3 * 3
            paths[i].append(("".join(level[g:m]), "".join(level[m + 1 : g + 3])))
        member = [m // 3 for m in member]
        level = [digest(*level[g : g + 3]) for g in range(0, len(level), 3)]
    return level[0], paths


def proofs(rows):
    leaf = lambda r, text: digest(*(field(v) for v in (r[0], r[3], r[2], r[4], text)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([leaf(r, r[1]) for r in by[s]]) for s in order}
    root, above = tree([tops[s][0] for s in order])
    for s, way in zip(order, above):
        for r, path in zip(by[s], tops[s][1]):
            text, path = r[1], path + way
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path:
                node = digest(left, node, right)
            yield r[0], leaf(r, r[1]), tops[s][0], root, digest(*(a + b for a, b in path)), node, node == root


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_merkle(docs, rows, digits):
    got = [tuple(r) for r in merkle.verified_proofs(docs, digits).collect()]
    want = list(proofs(rows))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[6] for r in want} == {True, False}


def test_merkle_small_tables(docs, rows):
    assert merkle.verified_proofs(docs.limit(0)).count() == 0
    one = merkle.verified_proofs(docs.filter("doc_id = 5000")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == digest()


def test_ranks_go_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("if(id % 3 = 0, null, cast(id % 2 as string)) AS tree", "id DIV 4 AS x")
    got = merkle.ranked(df, ["tree"], ["x"]).collect()
    for t in (None, "0", "1"):
        own = sorted((r["rank"], r["x"], r["total"]) for r in got if r["tree"] == t)
        assert [r[0] for r in own] == list(range(len(own))) and [r[1] for r in own] == sorted(r[1] for r in own) and {r[2] for r in own} == {len(own)}


PAGES = [(i, f"http://h/{i}", "<p>%d</p>" % (i % 40) * 30) for i in range(120)] + [
    (7000, None, None), (7001, "a b\r\nX: é", "x" * 99), (7002, "", "x" * 99), (None, None, "y" * 100), (7003, None, "y" * 100), (7004, None, "é" * 50),
    (7005, "u", "é" * 50), (6999, "u", "z" * 3_000_000), (7006, "u", "z" * 3_000_000), (7007, "u", "w" * 200), (7007, "u", "w" * 200), (None, "u", "v" * 300), (None, "u", "v" * 300),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"name": F.lit("n"), "digest": F.lit(1), "first": F.lit(2)}).repartition(3)
    records = warc.with_references(pages)
    archives = warc.write_archives(records, warc.shared_dir(spark) + "/warc-test", archive_bytes=20_000)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(PAGES) == sum(r["frames"] for r in archives.collect()) and all(r["error"] is None for r in got)
    smallest = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        smallest[b] = i if smallest.get(b) is None else smallest[b] if i is None else min(i, smallest[b])
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        other = smallest[b] if len(b) >= 100 and i != smallest[b] else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if other is None else "revisit", other))
    assert sorted((tuple(r) for r in warc.page_digests(archives).drop("error").collect()), key=str) == sorted(want, key=str)
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        assert not re.search(r"\s", r["target_uri"])
    assert warc.page_digests(warc.archived_pages(pages.limit(0))).count() == 0


def archive(records, words=None, packed=False, junk=b""):
    packer = zstandard.ZstdCompressor(dict_data=words) if words else zstandard.ZstdCompressor()
    raw = words.as_bytes() if words else b""
    raw = zstandard.ZstdCompressor().compress(raw) if packed else raw
    lead = struct.pack("<II", 0x184D2A5D, len(raw)) + raw if words else b""
    return lead + junk + b"".join(packer.compress(r) for r in records)


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    pick = lambda: " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(50)) for _ in range(200)).encode()
    body = [pick() for _ in range(300)]
    return [warc.record_bytes(f"urn:page:{i}", f"http://h/{i}", b, hashlib.sha256(b).hexdigest(), len(b), None, "2020-01-01T00:00:00Z") for i, b in enumerate(body)]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_frames_with_dictionaries(records, block):
    words = zstandard.train_dictionary(4096, records)
    skipped = struct.pack("<II", 0x184D2A51, 5) + b"other"
    for packed in (False, True):
        few = records[:20] if block == 1 else records
        assert list(warc.frames(io.BytesIO(archive(few, words, packed, skipped)), block)) == few
    assert list(warc.frames(io.BytesIO(archive(records[:5])), block)) == records[:5]
    assert list(warc.frames(io.BytesIO(b""), block)) == []


def test_broken_archives_end_with_an_error(records):
    whole = archive(records[:3])
    got = list(warc._rows("a", io.BytesIO(whole[:-9])))
    assert [r.get("error") for r in got] == [None, None, "archive ends inside a frame"] and [r["place"] for r in got] == [0, 1, 2]
    assert [r.get("error") for r in warc._rows("a", io.BytesIO(whole + b"\x1f\x8bgarbage"))][3:] == ["not a Zstandard frame"]
    assert list(warc._rows("a", io.BytesIO(gzip.compress(records[0]))))[0]["error"] == "not a Zstandard frame"
    assert "dictionary" in list(warc._rows("a", io.BytesIO(struct.pack("<II", 0x184D2A5D, 4) + b"oops")))[0]["error"]


def test_records_are_validated(records):
    good = records[0]
    assert warc.parsed(good)["payload_bytes"] > 0
    for change, says in [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), "not a WARC"), (lambda r: r.replace(b"WARC-Type", b"X-Type"), "WARC-Type is missing"),
        (lambda r: r[:-1], "Content-Length differs"), (lambda r: r + r, "Content-Length differs"), (lambda r: r.replace(b"alpha", b"ALPHA", 1), "block digest"),
        (lambda r: re.sub(rb"WARC-Block[^\r]*\r\n", b"", r).replace(b"alpha", b"ALPHA", 1), "payload digest"), (lambda r: r.replace(b"\r\n\r\n", b"\r\n", 3), "header"),
        (lambda r: r.replace(b"WARC-Date:", b"WARC-Type: x\r\nWARC-Date:"), "twice"), (lambda r: r.replace(b"WARC-Date:", b"no colon\r\nWARC-Date:"), "without a name"),
    ]:
        with pytest.raises(warc.Malformed, match=says):
            warc.parsed(change(good))
    rows = list(warc._rows("a", io.BytesIO(archive([good, b"nothing", records[1]]))))
    assert [r.get("error") is None for r in rows] == [True, False, True] and [r["place"] for r in rows] == [0, 1, 2]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = ["".join(rng.choice("abAB é1 zZ") for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    return out + ["abcdefgh" * 5 + " abcdefgh" * 3 + " abcdefghi " + "q" * 30, "", "é" * 20, "a", "a" * 8, "a" * 9, "A" * 16, "a" * 17, "aÀ b", "longword" * 20_000]


@pytest.mark.parametrize("segment", [2, 64, 1 << 14])
def test_multikey_quicksort(texts, segment, monkeypatch):
    group = np.array([i % 3 for i in range(len(texts))])
    monkeypatch.setattr(divergence.sorted_runs, "__defaults__", (segment,))
    names, own, n, documents = divergence.shard_counts(pa.array(texts), group)
    want = collections.defaultdict(lambda: [0, 0])
    for text, g in zip(texts, group):
        for term, k in collections.Counter(terms(text)).items():
            want[term.encode(), g][0] += k
            want[term.encode(), g][1] += 1
    assert names == sorted(names)
    assert list(zip(names, own.tolist())) == sorted(want)
    assert [[a, b] for a, b in zip(n.tolist(), documents.tolist())] == [want[k] for k in sorted(want)]


def divergences(rows, least, top=50):
    count, having = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        count[lang or "", source or ""].update(terms(text))
        having[lang or ""].update(set(terms(text)))
    for lang in {k[0] for k in count}:
        kept = [t for t, n in having[lang].items() if n >= least]
        sources = [s for a, s in count if a == lang]

        def p(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        q = p(sum((count[lang, s] for s in sources), collections.Counter()))
        each = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(each[s][t] - each[x][t]) for t in kept), x.encode()) for x in sources if x != s)
            above = sorted((q[t] - each[s][t], t.encode()) for t in kept if count[lang, s][t] and each[s][t] > q[t])[:top]
            for part, items in (("pair", pairs), ("term", above)):
                yield from ((lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(items))


@pytest.mark.parametrize("least,terms_a_bucket,sources_a_block", [(3, 1024, 64), (3, 3, 2), (500, 3, 2)])
def test_divergence(spark, texts, least, terms_a_bucket, sources_a_block, monkeypatch):
    monkeypatch.setattr(divergence, "BUCKET_TERMS", terms_a_bucket)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", sources_a_block)
    rng = random.Random(5)
    rows = [(t, rng.choice(["en", None, ""]), rng.choice(["a", "b", None, "", "é"])) for t in texts] + [(None, "xx", "q"), ("zz", "xx", "r"), ("1 2", "yy", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"bucket": F.lit(1), "p": F.lit("p"), "item": F.lit(None).cast("string")}).repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(df, least).collect()]
    assert sorted(got, key=str) == sorted(divergences(rows, least), key=str)
    assert divergence.source_divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_long_documents_are_cut_where_the_sum_of_squares_falls_most(seed):
    rng, size = random.Random(seed), 20
    packer = packing.SumOfSquares(size)

    def after(count, length, level):
        count = count.copy()
        count[level] -= level > 0
        count[(level + length) % size] += length > 0
        return count * (np.arange(size + 1) % size > 0)

    def least(n, head):
        """The sum of squares once the head has filled a window and the rest has filled one or opened one; without a head, the least of all places."""
        count, rest = packer.count, (n - head) % size
        if head and not count[size - head]:
            return None
        if head:
            count = after(count, head, size - head)
            places = [size - rest if rest and count[size - rest] else 0]
        else:
            places = [0] + [h for h in range(1, size + 1 - rest) if rest and count[h]]
        return min(int((after(count, rest, h) ** 2).sum()) for h in places)

    for _ in range(300):
        n = rng.randint(1, 70)
        if n <= size:
            packer.put((0, 0, n))
            continue
        head = packer.head(n)
        ways = {a: least(n, a) for a in range(size)}
        assert ways[head] == min(w for w in ways.values() if w is not None)
        for at in ([0] if head else []) + list(range(head, n, size)):
            packer.put((0, at, head - at if at < head else min(size, n - at)))


def test_most_windows_close_by_sum_of_squares():
    # eight partitions of 1,250 documents: of the windows that more than one piece shares, few are left to be topped up
    rng, size, filled, left = random.Random(3), 1024, 0, 0
    for _ in range(8):
        packer = packing.SumOfSquares(size)
        for k in range(1250):
            n = int(rng.lognormvariate(6.4, 1))
            head = packer.head(n) if n > size else 0
            for at in ([0] if head else []) + list(range(head, n, size)):
                length = head if at < head else min(size, n - at)
                filled += length < size and bool(packer.put((k, at, length)))
        filled += len(packer.again())
        left += -(-sum(p[2] for w in packer.flush() for p in w) // size)
    assert filled >= 4 * left


def test_placing_anew_keeps_every_piece():
    rng = random.Random(5)
    packer, want = packing.SumOfSquares(64), []
    for k in range(500):
        piece = (k, 0, rng.randint(1, 60))
        want.append(piece)
        full = packer.put(piece)
        if full:
            assert sum(p[2] for p in full) == 64
            want = [p for p in want if p not in full]
    again = packer.again()
    assert all(sum(p[2] for p in w) == 64 for w in again)
    assert sorted(p for w in [*again, *packer.flush()] for p in w) == sorted(want) and not packer.count.any()
