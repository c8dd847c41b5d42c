"""Training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeats, odd columns."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from odflow.llm import bpe, html_text, language, media, near_dedup, packing, quality, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, keeps string, n long, component long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["w%d" % i for i in range(120)] + ["é", "Straße", "it's", "12", "!?", "日本"]
    out = []
    for i in range(160):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 30, 90])))
        if i > 10 and rng.random() < 0.5:
            other = out[rng.randrange(len(out))][1] or ""
            t = t[: len(t) // 2] + other[: rng.randrange(0, 500)] + t[len(t) // 2 :]
        out.append((i, t))
    out += [(160, None), (161, ""), (162, "x" * 3000), (163, out[3][1]), (164, "é" * 400), (165, "w1 w2 w3 " * 400), (166, " \n\t ")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", 1, "k", "s", "q", 1, 2) for i, t in rows], DOCS).repartition(3).cache()


def test_suffix_dedup(docs, rows):
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removal_digests(suffix_dedup.repeated_spans(docs, filter_bits=1 << 14)).collect()}
    assert got == want


def test_suffix_dedup_empty_table(docs):
    assert suffix_dedup.repeated_spans(docs.limit(0), filter_bits=1 << 12).count() == 0


def test_bpe(docs, rows):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path, P.PATTERN).collect()}
    for i, t in rows:
        ids = np.array(own.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["valid_utf8"]


def test_streaming_decode(rows):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encode, stream = bpe.transducer_encoder(path, P.PATTERN), bpe.Stream(bpe.decoder(path))
    for _, t in rows:
        if t:
            assert "".join(stream.feed([i]) for i in np.frombuffer(encode([t])[0], "<u4")) == t


def test_library_ids(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encode = bpe.library_encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for _, t in rows:
        assert encode(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_library_ids_of_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, encode, end = Tokenizer.from_file(path), bpe.library_encoder(path, P.PATTERN), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x{end}y  {end}  z \n", f" {end}", f"{end} ", f"it{end}'s", "<|endoftext", f"<|{end}|>", f"é{end}日本 \t{end}\n\n{end}12", "<|ENDOFTEXT|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [encode(t).tolist() for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pack_sum_of_squares(docs, path, P.PATTERN, 256).collect():
        assert (r["start"], r["ids_crc32"]) == (0, zlib.crc32(np.array([*want[r["doc_id"]], 0], "<u4").tobytes()))
    for r in packing.pack_best_fit(docs, path, P.PATTERN, 256).collect():
        ids, ends = np.frombuffer(r["ids"], "<u4").tolist(), r["cu_seqlens"]
        assert all(ids[ends[k] : ends[k + 1]] == [*want[doc], 0] for k, doc in enumerate(r["doc_ids"]))


def test_packing_is_lossless(docs, rows):
    path = P.path("byte_bpe_50k.json")
    encode = bpe.library_encoder(path, P.PATTERN)
    want = {i: np.append(encode(t or ""), np.uint32(0)) for i, t in rows}
    pieces = packing.pack_sum_of_squares(docs, path, P.PATTERN, 256).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    found = collections.defaultdict(dict)
    for r in packing.pack_best_fit(docs, path, P.PATTERN, 256, block=4000).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) <= 256
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            found[doc][start] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    assert all(np.concatenate([found[i][s] for s in sorted(found[i])]).tolist() == ids.tolist() for i, ids in want.items())


def test_best_fit_query_gives_padded_matrices(spark, docs, rows, tmp_path):
    from odflow.llm.queries import op3_best_fit_packing

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    encode, found = bpe.library_encoder(P.path("byte_bpe_50k.json"), P.PATTERN), collections.defaultdict(dict)
    padded = 0
    for r in op3_best_fit_packing(spark, f"file://{tmp_path}").collect():
        ids, places, ends = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(places) == 1024 and not ids[ends[-1] :].any() and not places[ends[-1] :].any()
        assert places[: ends[-1]].tolist() == [k for a, b in zip(ends, ends[1:]) for k in range(b - a)]
        assert bytes(r["ids"]) == ids[: ends[-1]].tobytes() and (r["n_tokens"], r["n_segments"]) == (ends[-1], len(ends) - 1)
        assert [r[c] for c in ("ids_sha256", "input_sha256", "position_sha256")] == [hashlib.sha256(r[c]).hexdigest() for c in ("ids", "input_ids", "position_ids")]
        padded += ends[-1] < 1024
        for k, (doc, start) in enumerate(zip(r["doc_ids"], r["starts"])):
            found[doc][start] = ids[ends[k] : ends[k + 1]]
    assert padded and set(found) == {i for i, _ in rows}
    assert all(np.concatenate([found[i][s] for s in sorted(found[i])]).tolist() == [*encode(t or ""), 0] for i, t in rows)


def test_best_fit_decreasing_takes_the_tightest_window():
    assert packing.best_fit_decreasing([6, 5, 5, 4, 25], 10) == [[(4, 0, 10)], [(4, 10, 10)], [(0, 0, 6), (3, 0, 4)], [(1, 0, 5), (2, 0, 5)], [(4, 20, 5)]]


def test_sum_of_squares_level():
    rng, packer = random.Random(1), packing.SumOfSquares(20)
    for k in range(300):
        n = rng.randint(1, 20)
        before = packer.count.copy()
        costs = {}
        for h in range(21 - n):
            if h == 0 or before[h]:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + n < 20:
                    after[h + n] += 1
                costs[h] = int((after[:20] ** 2).sum())
        assert costs[packer.level(n)] == min(costs.values())
        packer.put((k, 0, n))


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.verdicts(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        words = WORD.findall(t or "")
        trios = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = collections.Counter(trios)
        covered = {k + j for k, x in enumerate(trios) if many[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words))
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_quality_of_a_source_that_is_mostly_junk(spark):
    rng = random.Random(6)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    junk = lambda: " ".join(w + " ###" for w in prose().split())
    made = [("good", prose(), True) for _ in range(120)] + [("bad", junk(), False) for _ in range(20)] + [("bad", prose(), True) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "en", source) for i, (source, t, _) in enumerate(made)], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"]: r["kept"] for r in quality.verdicts(docs).collect()} == {i: keep for i, (_, _, keep) in enumerate(made)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(docs, size, filter_bits=1 << 14).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates_finds_isolated_links_in_large_buckets(spark):
    # sets of one-word shingles: a template of which each text has a share of its own, and pairs much closer than that
    rng, texts = random.Random(8), []
    for i in range(550):
        words = ["t%d" % k if rng.random() < 0.91 else "u%d_%d" % (i, k) for k in range(300)]
        texts.append(words)
        if i < 60:
            texts.append([w if rng.random() < 0.95 else "v%d_%d" % (i, k) for k, w in enumerate(words)])
    rng.shuffle(texts)
    sets = [set(t) for t in texts]
    least = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            if least[a] != least[b] and 100 * len(x & sets[b]) >= 80 * len(x | sets[b]):
                low, high = sorted((least[a], least[b]))
                least = [low if c == high else c for c in least]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 1, filter_bits=1 << 14).collect()}
    assert got == dict(enumerate(least))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_undetermined(docs):
    got = {r["doc_id"]: r for r in language.predictions(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (160, 161, 166))


def test_toxicity_locates_sentences():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    texts = [". ".join(" ".join(word() for _ in range(6)) for _ in range(5)) for _ in range(120)]
    labels = [i % 3 == 0 for i in range(120)]
    texts = [t + ". you are vile" + word() if y else t for t, y in zip(texts, labels)]
    model = toxicity.Model(texts, [int(y) for y in labels])
    found = model.sentences("fine words here. such vilexyz things. more")
    assert found[1][1] > 0.3 and found[0][1] == found[2][1] == 0.0


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extracted(pages).collect():
        body = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body))
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_region_follows_scores(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    head = '<html><head><title>t</title></head><body><nav><ul><li><a href="/">home</a></li></ul></nav>'
    words = lambda name: " ".join(f"{name}{k}" for k in range(60))
    body = f"<p>{words('x')}</p><p>{words('y')}</p>"
    cards = "".join(f"<article class='{c}'><h3>card {c}</h3><p>read more</p></article>" for c in ("teaser", "related", "card"))
    main = f"{words('x')} {words('y')}"
    assert model.text(f"{head}<div class='content'>{body}</div><footer>end</footer></body></html>") == main
    assert model.text(f"{head}<div class='content'>{body}</div>{cards}<footer>end</footer></body></html>") == main
    assert model.text(f"{head}{cards}<div class='content'>{body}</div><footer>end</footer></body></html>") == main
    assert model.text(f"{head}<article><p>{words('x')}</p></article><article><p>{words('y')}</p></article></body></html>") == main
    assert {-0.5 <= g <= 1.0 for g in model.gain.values()} == {True} and model.gain["p"] == 1.0


def test_media(docs, rows):
    got = {r["doc_id"]: r for r in media.media_features(media.stored_media(docs)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3]["feature"] == got[163]["feature"] and got[3]["media_sha256"] == got[163]["media_sha256"]


@pytest.mark.parametrize("extra", [0, 64, 64 * 70])
def test_media_beyond_the_highest_picture(extra):
    border = 64 * 64 * 8191
    payload = np.random.default_rng(3).integers(0, 256, 1 << 16, dtype=np.uint8).tobytes() * (border // (1 << 16) + 2)
    payload = payload[: border + extra]
    file = media.encode(payload)
    picture = media.Picture(file)
    assert (picture.width, picture.height) == ((512, 65528) if not extra else (520, 8 * -(-len(payload) // 64 // 65)))
    if extra == 64:
        (_, value), = media.decode([file])
        assert media.payload_of(value, len(payload) // 64) == payload
