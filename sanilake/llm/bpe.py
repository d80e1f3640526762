"""Byte-pair encoding and decoding as streaming transducers.

Encoding.  Merges are applied by rank.  How far text to come can change the
tokens behind it is bounded: a merge (u, v) that only one of two continuations
allows moves the last common token boundary left by u, and the next such merge
must have a higher rank and a right part that begins with u.  The longest chain
of this kind, summed over its left parts, is the merge list's sufficient
lookahead.  A boundary with that many bytes behind it is final, so tokens before
it are emitted and forgotten: memory doesn't grow with the text.

Pieces of the pre-tokenizer that are shorter than the window are encoded at
once, and remembered up to CACHED pieces.

Decoding.  Token bytes go through an incremental UTF-8 state machine, which
holds at most three bytes of a character that hasn't ended.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.texts import add_columns, fresh

CACHED = 400_000  # pieces a worker remembers
CHUNK = 1 << 16  # characters pre-tokenized at a time
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def unlike_byte_level(said: dict) -> list[str]:
    """What a tokenizers JSON file asks for that isn't done here."""
    model, split = said["model"], said.get("pre_tokenizer") or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False, "byte_fallback": False}
    wrong = [f"model {k} {model[k]!r}" for k, v in plain.items() if (model.get(k) or None) != (v or None)]
    wrong += [f"normalizer {said['normalizer']!r}"] if said.get("normalizer") else []
    if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True):
        wrong.append(f"pre_tokenizer {split!r}")
    return wrong + [f"added token {x['content']!r}" for x in said["added_tokens"] if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]


class Bpe:
    """A byte-level merge list from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        if wrong := unlike_byte_level(said):
            raise ValueError(f"{path} is no plain byte-level merge list: {wrong}")
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = {as_bytes(t): i for t, i in said["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        self.lookahead = self.sufficient_lookahead()
        self.window = 2 * self.lookahead + 64
        self.pieces = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes after which no continuation can move a token boundary."""
        first_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # by left part: the longest chain ending in a merge with it
        longest = 0
        for (u, v), rank in sorted(self.rank.items(), key=lambda x: x[1]):
            before, x = 0, v
            while True:
                before = max(before, reach.get(x, 0))
                if x not in first_part:
                    break
                x = first_part[x]
            here = before + len(self.bytes_of[u])
            reach[u] = max(reach.get(u, 0), here)
            first_part.setdefault(self.made[rank], u)
            longest = max(longest, here)
        return longest

    def merge(self, raw: bytes) -> list[int]:
        """The tokens of a short piece: lowest rank first, then leftmost."""
        ids = [self.byte_id[b] for b in raw]
        if len(ids) > 48:
            return self.merge_long(ids)
        rank, made, none = self.rank.get, self.made, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k : k + 2] = [made[least]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of the pairs that can merge."""
        n, ranks = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            least, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = self.made[least], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for i, o in ((before[k], k), (k, after[k])):
                if 0 <= i and o < n and (ids[i], ids[o]) in ranks:
                    heapq.heappush(heap, (ranks[ids[i], ids[o]], i, ids[i], ids[o]))
        return [x for x in ids if x >= 0]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The tokens of one piece that comes in chunks, each as soon as it is final."""
        held = b""
        for chunk in chunks:
            for at in range(0, len(chunk), self.window):
                held += chunk[at : at + self.window]
                if len(held) > self.window:
                    final, done = len(held) - self.lookahead, 0
                    for token in self.merge(held):
                        size = len(self.bytes_of[token])
                        if done + size > final:
                            break
                        yield token
                        done += size
                    held = held[done:]
        yield from self.merge(held)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) > self.window:
            return array("I", self.transduce([raw])).tobytes()
        found = array("I", self.merge(raw)).tobytes()
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[piece] = found
        return found

    def chunks(self, text: str) -> Iterator[str]:
        """Cuts a text where a piece must end: before a space between two ASCII letters."""
        at = 0
        while len(text) - at > 2 * CHUNK:
            cut = _CUT.search(text, at + CHUNK)
            if not cut:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        get = self.cache.get
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for chunk in self.chunks(part):
                pieces = self.pieces.findall(chunk)
                out.append(b"".join([get(p) or self.__missing__(p) for p in pieces]))
        return b"".join(out)

    def decode(self, ids: bytes | memoryview) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD, as far as they go."""
        machine, table, out = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of, []
        every = memoryview(ids).cast("I")
        for at in range(0, len(every), CHUNK):
            out.append(machine.decode(b"".join([table[i] for i in every[at : at + CHUNK]])))
        out.append(machine.decode(b"", True))
        return "".join(out)


_CUT = regex.compile(r"[A-Za-z](?= [A-Za-z])")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One for each worker process."""
    return Bpe(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replaces the text by its ids: binary, little-endian unsigned 32-bit integers, and n_tokens.

    path: a tokenizers JSON file that every worker can open.  Null and empty
    texts have no ids.  Repeated rows are encoded alike.  Bytes that are not UTF-8 count as U+FFFD.
    """
    fields = T.StructType([T.StructField(out, T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def compute(s: textvec.Slice) -> list:
        bpe, raw = load(path), s.data.tobytes()
        ids = [bpe.encode(raw[a:b].decode(errors="replace")) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return add_columns(docs, text, fields, compute, drop_text=True)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ids as encode_texts() writes them; null ids have an empty text."""

    def compute(s: textvec.Slice) -> list:
        bpe, raw = load(path), s.data.tobytes()
        return [pa.array([bpe.decode(raw[a:b]) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)], pa.string())]

    return add_columns(docs, ids, T.StructType([T.StructField(out, T.StringType())]), compute)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes every text; adds n_tokens and the digests of ids and decoded text."""
    ids, decoded = fresh(docs, "ids"), fresh(docs, "decoded")
    both = decode_ids(encode_texts(docs, path, text, ids), path, ids, decoded)
    return both.withColumns({"ids_sha256": F.sha2(F.col(ids), 256), "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256)}).drop(ids, decoded)
