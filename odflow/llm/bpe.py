"""Byte-level BPE as a transducer, and decoding as a UTF-8 state machine.

Encoding. A token sequence is the BPE of its bytes exactly if each two neighbours are the BPE of theirs; so the BPE of
every prefix has one last token, and that token follows from the bytes it covers and the last token before it.
``Transducer`` reads bytes with the automaton of all tokens that may end at a byte (the vocabulary's trie started at every
byte), determinised lazily: a move is worked out when first met and held. Its registers are the last tokens of the
prefixes that an open token could start from, as many as the longest token has bytes. A token is emitted when the paths
of all those prefixes share it, which is the bounded lookahead. Whether two tokens may stand side by side is worked out
from the merges when first asked, and held in a table of bounded size.

Vocabulary files of two kinds are read: ranks (one base64 token and its rank a line) and the tokenizers library's JSON.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa

from odflow.llm.common import slices


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file, or of a byte-level BPE in a tokenizers .json (id order there equals merge order)."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    # printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    return {bytes(stand[c] for c in token): i for token, i in vocab.items()}


def load_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizers .json and their ids; those that a plain search for their text finds are read."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} is not matched by its text alone")
    return {token["content"]: token["id"] for token in added}


class Transducer:
    """BPE of one vocabulary. ``limit`` bounds the moves and the checked pairs held at once."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 600_000):
        self.ranks, self.limit = ranks, limit
        self.tokens = {v: k for k, v in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        # trie: (node << 8 | byte) -> node; of each node the node of its longest proper suffix, and its depth
        self.trie: dict[int, int] = {}
        self.suffix, self.depth, own = [0], [0], [-1]
        todo = sorted(ranks, key=len)
        width, at = 0, [0] * len(todo)
        while todo:  # level by level, so that suffixes are there before they are needed
            for k, token in enumerate(todo):
                node, byte = at[k], token[width]
                child = self.trie.get(node << 8 | byte)
                if child is None:
                    child = self.trie[node << 8 | byte] = len(self.depth)
                    back = self.suffix[node]
                    while node and back and (back << 8 | byte) not in self.trie:
                        back = self.suffix[back]
                    self.suffix.append(self.trie.get(back << 8 | byte, 0) if node else 0)
                    self.depth.append(width + 1)
                    own.append(-1)
                at[k] = child
                if len(token) == width + 1:
                    own[child] = ranks[token]
            width += 1
            keep = [k for k, token in enumerate(todo) if len(token) > width]
            todo, at = [todo[k] for k in keep], [at[k] for k in keep]
        self.longest, self.own = width, own
        # tokens that end at a node and that BPE can make, longest first; filled when first asked for
        self.ends: list[tuple | None] = [None] * len(own)
        self.moves = dict(self.trie)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this one (itself twice: a byte; None: BPE never makes it)."""
        if token in self.halves:
            return self.halves[token]
        raw, ranks = self.tokens[token], self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            best, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        known = all(p in ranks for p in parts)
        out = (token, token) if len(raw) == 1 else (ranks[parts[0]], ranks[parts[1]]) if known and len(parts) == 2 else None
        self.halves[token] = out
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE of a's and b's bytes is a, b; a = -1: whether BPE makes b at all."""
        return self.split(b) is not None and (a < 0 or self._apart(a, b))

    def _apart(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, latest first: no join over the border may come before the merge undone last."""
        tokens, ranks, undone = self.tokens, self.ranks, 1 << 60
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < undone:
                return False
            tail, head = self.split(left)[1], self.split(right)[0]
            whole_left, whole_right = tail == left, head == right
            if whole_left and whole_right:
                return True
            # on equal ranks the left merge comes first, so the right one is undone first
            if whole_right or (left > right and not whole_left):
                undone, left = left, tail
            else:
                undone, right = right + 1, head

    def _move(self, node: int, byte: int) -> int:
        at = node
        while at and (at << 8 | byte) not in self.trie:
            at = self.suffix[at]
        to = self.trie.get(at << 8 | byte, 0)
        if len(self.moves) > self.limit + len(self.trie):
            self.moves = dict(self.trie)
        self.moves[node << 8 | byte] = to
        return to

    def _ends(self, node: int) -> tuple:
        found, at = [], node
        while at:
            token = self.own[at]
            if token >= 0 and self.split(token) is not None:
                found.append((token, self.depth[at]))
            at = self.suffix[at]
        self.ends[node] = out = tuple(found)
        return out

    def _path(self, last: list[int], start: int, end: int) -> list[int]:
        out, tokens = [], self.tokens
        while end > start:
            token = last[end]
            out.append(token)
            end -= len(tokens[token])
        out.reverse()
        return out

    def feed(self, piece: bytes) -> list[int]:
        """Tokens of one piece, as BPE joins them."""
        ends, pairs = self.ends, self.pairs
        if len(pairs) > self.limit:
            pairs.clear()
        node, last, out, done = 0, [-1], [], 0
        for i, byte in enumerate(piece, 1):
            to = self.moves.get(node << 8 | byte)
            node = self._move(node, byte) if to is None else to
            for token, length in ends[node] or self._ends(node):
                before = last[i - length]
                pair = before << 20 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.fits(before, token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {byte}")
            if i - done >= 4096:  # emit what every open path shares
                paths = [self._path(last, done, j) for j in range(i - min(self.longest, i - done) + 1, i + 1)]
                same = next((k for k, t in enumerate(zip(*paths)) if len(set(t)) > 1), min(map(len, paths)))
                out += paths[0][:same]
                done += sum(len(self.tokens[t]) for t in paths[0][:same])
        return out + self._path(last, done, len(piece))


class Held:
    """A bounded table of strings and their ids."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit // 2, {}, {}

    def ready(self, wanted: set[str], make):
        """A function from each wanted string to its ids."""
        young, old = self.young, self.old
        if len(young) > self.limit:
            young, old = self.young, self.old = {}, young
        new = []
        for w in wanted:
            if w not in young:
                got = old.get(w)
                if got is None:
                    new.append(w)
                else:
                    young[w] = got
        young.update(zip(new, make(new)))
        return young.__getitem__


#: UTF-8 states: 0 between characters, 1-3 that many plain continuation bytes to come, 4-7 after E0, ED, F0, F4, 8 error.
_ERROR = 8


def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), _ERROR, np.int8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0], t[0, 0xE1:0xF0], t[0, 0xF1:0xF4] = 1, 2, 3
    t[0, 0xE0], t[0, 0xED], t[0, 0xF0], t[0, 0xF4] = 4, 5, 6, 7
    for state, lo, hi, then in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        t[state, lo:hi] = then
    return t


class Decoder:
    """Ids to bytes in a stream. Each token is one move of the UTF-8 machine, worked out once per token and state."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        table = _utf8_table()
        self.move = np.empty((9, size), np.int8)
        for i, token in enumerate(self.bytes):
            state = np.arange(9)
            for b in token:
                state = table[state, b]
            self.move[:, i] = state
        #: tokens that are whole characters leave state 0 as it is
        self.whole = self.move[0] == 0

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """All bytes, and whether they are UTF-8 to the end."""
        state, move = 0, self.move
        odd = np.flatnonzero(~self.whole[ids])
        at, n = 0, len(odd)
        while at < n and state != _ERROR:  # only stretches with split characters are walked
            i = int(odd[at])
            state = 0
            while i < len(ids):
                state = int(move[state, ids[i]])
                i += 1
                if state in (0, _ERROR):
                    break
            at = int(np.searchsorted(odd, i))
        return b"".join(map(self.bytes.__getitem__, ids.tolist())), state == 0


class Stream:
    """Incremental decoding: ``feed`` returns the text completed so far; bytes of an open character wait."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.state, self.rest = decoder, 0, b""

    def feed(self, ids) -> str:
        raw = self.rest + b"".join(self.decoder.bytes[i] for i in ids)
        state, done = 0, 0
        for i, b in enumerate(raw):
            state = int(_TABLE[state, b])
            if state == _ERROR:
                raise ValueError(f"not UTF-8 at byte {i}")
            if state == 0:
                done = i + 1
        self.rest, self.state = raw[done:], state
        return raw[:done].decode()


_TABLE = _utf8_table()


@functools.lru_cache(maxsize=4)
def transducer_encoder(path: str, pattern: str, hold: int = 1_000_000):
    """texts -> ids (little-endian unsigned 32-bit, as bytes) by a rank file's transducer; one a worker process.

    A piece that is a token is that token, as rank-file libraries have it. Ids of at most ``hold`` pieces are held.
    """
    import regex

    machine, split, held = Transducer(load_ranks(path)), regex.compile(pattern).findall, Held(hold)

    def one(piece: str) -> bytes:
        raw = piece.encode()
        token = machine.ranks.get(raw)
        return array("I", [token] if token is not None else machine.feed(raw)).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        pieces = [split(t) for t in texts]
        get = held.ready({p for own in pieces for p in own}, lambda new: map(one, new))
        return [b"".join(map(get, own)) for own in pieces]

    return encode


@functools.lru_cache(maxsize=4)
def library_encoder(path: str, pattern: str):
    """text -> ids (numpy) as the tokenizers library gives them for a byte-level BPE JSON file (add_special_tokens=False).

    The tiktoken library encodes by the file's own vocabulary, with a third of the work; tests hold its ids against the
    tokenizers library. The file's added tokens are cut out of the text before the merges, as that library does.
    """
    import tiktoken

    added = load_added(path)
    library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens=added)
    allowed = set(added)
    return lambda text: library.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


@functools.lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def round_trip(docs, path: str, pattern: str, text: str = "text"):
    """Encode and decode every text: (doc_id, n_tokens, ids_sha256, decoded_sha256, valid_utf8). Null text is empty.

    The ids are those of the tiktoken library without special tokens. Repeated rows each have their row; other columns
    are ignored. One map over the table: no shuffle, and memory of a few tables of bounded size a worker.
    """
    from pyspark.sql import functions as F

    def digests(batches):
        encoder, back = transducer_encoder(path, pattern), decoder(path)
        for batch in slices(batches, "text"):
            rows = []
            for ids in encoder(batch.column("text").to_pylist()):
                raw, valid = back.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest(), valid))
            n, ids, raw, valid = zip(*rows) if rows else ((),) * 4
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string()), pa.array(valid, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")


def encoded(docs, path: str, pattern: str, text: str = "text"):
    """(doc_id, ids array<int>) of every text."""
    from pyspark.sql import functions as F

    def ids_of(batches):
        encoder = transducer_encoder(path, pattern)
        for batch in slices(batches, "text"):
            rows = [np.frombuffer(x, "<i4") for x in encoder(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(ids_of, "doc_id long, ids array<int>")
