"""The whole pipeline against brute force on a small table with planted cases."""

import collections
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, cut_id long, kept string, component long"
#: ratio: slack, whether low values are bad as well
FENCES = {"symbols": (0.05, False), "chars": (0.5, True), "lines": (0.01, False)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = {lang: [lang + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(900)] for lang in ("un", "do")}
    prose = lambda lang, n: [rng.choice(vocab[lang]) for _ in range(n)]
    out = [(i, " ".join(prose("un" if i % 2 else "do", rng.randrange(55, 160))), "un" if i % 2 else "do") for i in range(70)]
    passage = " ".join(prose("un", 60))

    def add(text, lang="un"):
        out.append((len(out), text, lang))

    for i in (3, 7, 7, 12):  # exact copies
        add(out[i][1], out[i][2])
    for i, changes in ((5, 1), (8, 2), (15, 1), (20, 30)):  # near copies, and one too far off
        words = out[i][1].split()
        for at in rng.sample(range(len(words)), min(changes, len(words))):
            words[at] = "unchanged"
        add(" ".join(words), out[i][2])
    for _ in range(6):  # a passage that many share
        add(" ".join(prose("un", 70)) + " " + passage + " " + " ".join(prose("un", 70)))
    add(" ".join(str(rng.randrange(10**6)) for _ in range(80)))  # no letter
    add("too short")
    add("")
    add(None, None)
    add(" \n ")
    add("one two three " * 60)
    add(" ".join(w + " ####" for w in prose("un", 70)))
    add("\n".join([" ".join(prose("un", 12))] * 3 + [" ".join(prose("un", 90))]))
    add(" ".join(prose("un", 9000)))  # very long
    add(" ".join(prose("do", 80)), None)
    return [(i, t, lang, "web" if i % 4 else "book") for i, t, lang in out]


def measured(text):
    words = WORD.findall(text or "")
    trios = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(trios)
    repeated = {i + k for i, t in enumerate(trios) if count[t] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    n = max(1, len(words))
    return failed, {"symbols": len(re.findall(r"[#*$%&|<>]", text or "")) / n, "chars": sum(map(len, words)) / n, "lines": (len(lines) - len(set(lines))) / n}


def good(rows):
    facts = {r[0]: measured(r[1]) for r in rows}

    def beyond(group, name, value):
        values = sorted(facts[r[0]][1][name] for r in rows if not facts[r[0]][0] and group(r))
        low, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.75))
        slack, low_too = FENCES[name]
        width = 6.0 * (high - low + slack)
        return value > high + width or (low_too and value < low - width)

    for row in rows:
        failed, ratios = facts[row[0]]
        own, wide = (lambda r: r[2:] == row[2:]), (lambda r: r[2] == row[2])  # noqa: B023
        if not failed and not any(beyond(own, k, v) and beyond(wide, k, v) for k, v in ratios.items()):
            yield row


def distinct(rows):
    def shingles(text):
        words = [w.lower() for w in WORD.findall(text)]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets, least = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if least[a] < least[b] and 100 * len(x & y) >= 80 * len(x | y):
                    least[b], changed = least[a], True
    return [r for r in rows if least[r[0]] == r[0]]


def without_passages(rows):
    seen = set()
    for i, text, *_ in rows:
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            s = text[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        left = "".join(c for c, g in zip(text, gone) if not g)
        if left:
            yield i, left


def test_run(spark, rows, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "k", 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    kept = list(good(rows))
    assert len(rows) - 20 < len(kept) < len(rows) - 5
    kept = [r for r in kept if re.search(r"[^\W\d_]", r[1])]
    single = distinct(kept)
    assert len(single) < len(kept)
    want = dict(without_passages(single))
    assert sum(map(len, want.values())) < sum(len(r[1]) for r in single) - 5 * 300

    pieces = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert {p["doc_id"] for p in pieces} == set(want)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = collections.Counter()
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids = np.array(library.encode(want[p["doc_id"]], add_special_tokens=False).ids + [0], "<u4")
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(ids)
        at[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at[p["doc_id"]]].tobytes())
    assert all(at[p["doc_id"]] == p["doc_tokens"] for p in pieces)
    filled = collections.Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == filled[p["sequence_id"]]
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 1024


def test_stages_keep_columns_and_take_empty_tables(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 1, 2, "k", 3) for r in rows[:12]], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0
