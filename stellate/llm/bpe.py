"""BPE encoding by content-defined chunk reuse, and decoding.

A text is cut where a rolling hash of the bytes before a space says so, so copies of a
passage fall into the same chunks wherever they stand. Each chunk is encoded once in a
worker and kept. Where two chunks meet, the last words of the left one and the first words
of the right one are encoded again as one text by the tokenizer; words of both sides are
added until the outcome agrees with what each side had, and then the chunks are joined. Cuts
stand before single spaces between other characters, where a piece of the tokenizer's own
always ends, so this is nearly always at once.

A new chunk's words that no chunk held before are encoded together, in one call for a batch
of documents, and cut apart again: by token bytes for the byte-level tokenizer, by offsets
for the other one. Chunks with unusual white space go to the tokenizer whole.

Memories are Arrow arrays that live as long as a worker process, over all its tasks. They are bounded
by entries: of a full one those stay that were met again, so frequent chunks and words do. A chunk that
several workers meet is encoded in each; an exchange that brought every chunk to one place and its
tokens back would move more than it saves (README).

Defined cases: null and empty texts have no tokens; equal texts have equal tokens; repeated
rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .tables import per_text, table

_LOOSE = re.compile(r" \s|\s |\s\Z|\A\s")
#: White space to str.split() or to the tokenizer, but not surely to both.
_UNSURE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Letters alone, whose lower case is letters again, and ASCII marks after them: each is one piece to the word tokenizer.
_CORE = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:;=-@\[-`{-~]*)")
WORDS, CHUNKS, CHUNK_BITS, TOGETHER = 600_000, 20_000, 9, 20_000


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def joined(kinds: pa.Array, at: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The values of `kinds` at these places, one after the other, and the borders between them."""
    got = kinds.take(at)
    _, borders, data = got.buffers()
    return memoryview(data if data is not None else b""), np.frombuffer(borders, np.int64)[: len(got) + 1] if len(got) else np.zeros(1, np.int64)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


_KEPT: dict[tuple, object] = {}


def kept(kind, path: str):
    """An encoder that this process keeps from task to task."""
    if (kind.__name__, path) not in _KEPT:
        _KEPT[kind.__name__, path] = kind(path)
    return _KEPT[kind.__name__, path]


class Memory:
    """Ids by text in Arrow arrays. Of more than `most` entries those stay that were met since the last such time, the latest half of `most` at most."""

    def __init__(self, most: int):
        self.most, self.keys, self.ids, self.met = most, pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, bool)

    def of(self, keys: pa.Array, learn) -> pa.Array:
        """Ids of each of these different keys; learn() gives those of a list of keys that aren't held."""
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        lack = at < 0
        at[lack] = len(self.keys) + np.arange(lack.sum())
        if lack.any():
            new = keys.filter(pa.array(lack))
            ids = pa.array(learn(new.to_pylist()), pa.large_binary())
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.ids, ids])
            self.met = np.r_[self.met, np.ones(len(new), bool)]
        self.met[at] = True
        out = self.ids.take(pa.array(at))
        if len(self.keys) > self.most:
            stay = pa.array(np.flatnonzero(self.met)[-(self.most // 2) :])
            self.keys, self.ids, self.met = self.keys.take(stay), self.ids.take(stay), np.zeros(len(stay), bool)
        return out


class WordEncoder:
    """For a tokenizer that drops white space: ids (little-endian 32-bit) of whole texts, word by word."""

    def __init__(self, path: str):
        self.tok, self.words, self.cores = load(path), Memory(WORDS), Memory(WORDS)
        suffix = self.tok.model.end_of_word_suffix
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocab.values()) + 1, bool)
        self.closing[[i for s, i in vocab.items() if suffix and s.endswith(suffix)]] = True

    def _whole(self, s: str) -> bytes:
        return packed(self.tok.encode(s, add_special_tokens=False).ids)

    def _learn(self, new: list[str]) -> list[bytes]:
        out, parts, others = [b""] * len(new), [], []
        for i, w in enumerate(new):
            m = _CORE.fullmatch(w)
            if m:
                parts.append((i, m[1].lower(), m[2]))
            elif w:
                others.append(i)
        names = list(dict.fromkeys(c for _, c, _ in parts))
        cores = dict(zip(names, self.cores.of(pa.array(names, pa.large_string()), self._learn_cores).to_pylist(), strict=True))
        marks = {m: self._whole(m) for m in {m for _, _, m in parts}}
        for i, core, m in parts:
            out[i] = cores[core] + marks[m] if m else cores[core]
        for a in range(0, len(others), TOGETHER):
            some = [new[i] for i in others[a : a + TOGETHER]]
            got = self.tok.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            starts = np.fromiter((x for x, _ in got.offsets), np.int64, len(ids))
            at = np.searchsorted(starts, np.r_[0, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)])
            for i, x, y in zip(others[a : a + TOGETHER], at.tolist(), at[1:].tolist(), strict=False):
                out[i] = ids[x:y].tobytes()
        return out

    def _learn_cores(self, new: list[str]) -> list[bytes]:
        """Words that are one piece each, so each ends at a token that ends a word."""
        out = []
        for a in range(0, len(new), TOGETHER):
            some = new[a : a + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.closing[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise RuntimeError("the tokenizer cut a word of letters")
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Words are cut, told apart and replaced by their ids in Arrow arrays; Python sees each different word once."""
        odd = [_UNSURE_SPACE.search(t) is not None for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()))
        words = cut.values.dictionary_encode()
        data, ends = joined(self.words.of(words.dictionary, self._learn), words.indices)
        at = ends[np.asarray(cut.offsets)].tolist()
        return [self._whole(t) if o else bytes(data[x:y]) for t, o, x, y in zip(texts, odd, at, at[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class ChunkEncoder:
    """For the byte-level tokenizer: ids (little-endian 32-bit) of whole texts, chunk by chunk."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        self.tok, self.mask = load(path), np.uint64((1 << bits) - 1)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.words, self.chunks = Memory(WORDS), Memory(CHUNKS)
        self.joins = self.repaired = 0
        vocab = self.tok.get_vocab(with_added_tokens=True)
        shown = {c: b for b, c in _shown_bytes().items()}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = s.encode() if s in special else bytes(shown[c] for c in s)
        self.length = np.array(list(map(len, self.bytes_of)), np.int64)
        self.arrow_bytes = pa.array(self.bytes_of, pa.large_binary())

    def _whole(self, s: str) -> bytes:
        return packed(self.tok.encode(s, add_special_tokens=False).ids)

    def _learn(self, new: list[str]) -> list[bytes]:
        """Words as they stand after a space."""
        out = []
        for a in range(0, len(new), TOGETHER):
            text = " " + " ".join(new[a : a + TOGETHER])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.r_[np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)[1:], len(text.encode())]
            at = ((np.searchsorted(np.cumsum(self.length[ids]), ends) + 1) * 4).tolist()
            data = ids.tobytes()
            out += [data[x:y] for x, y in zip([0, *at], at, strict=False)]
        return out

    def cut(self, text: str) -> list[str]:
        """Content-defined chunks: cuts before spaces between ASCII letters or marks where a hash of the 8 bytes before is small in its low bits."""
        data = text.encode()
        if len(data) < 256:
            return [text]
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(b[8:-1] == 32) + 8
        at = at[(b[at - 1] > 32) & (b[at - 1] < 127) & (b[at + 1] > 32) & (b[at + 1] < 127)]
        if not len(at):
            return [text]
        h = np.zeros(len(at), np.uint64)
        for k in range(8, 0, -1):
            h = h * np.uint64(0x100000001B3) + b[at - k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        at = at[(h >> np.uint64(40)) & self.mask < np.uint64(8)]
        ends = [0, *at.tolist(), len(data)]
        return [data[x:y].decode() for x, y in zip(ends, ends[1:], strict=False)]

    @staticmethod
    def _by_words(chunk: str) -> bool:
        return chunk.startswith(" ") and not _LOOSE.search(chunk[1:]) and not _UNSURE_SPACE.search(chunk)

    def _learn_chunks(self, new: list[str]) -> list[bytes]:
        out = [b""] * len(new)
        plain, whole = [], []
        for i, c in enumerate(new):
            (plain if self._by_words(c) else whole).append(i)
        cut = pc.split_pattern(pa.array([new[i][1:] for i in plain], pa.large_string()), " ")
        words = cut.values.dictionary_encode()
        data, ends = joined(self.words.of(words.dictionary, self._learn), words.indices)
        at = ends[np.asarray(cut.offsets)].tolist()
        for i, x, y in zip(plain, at, at[1:], strict=False):
            out[i] = bytes(data[x:y])
        for i, e in zip(whole, self.tok.encode_batch_fast([new[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = packed(e.ids)
        return out

    def _sides(self, sides: list[str]) -> list[bytes]:
        """First and last words of chunks on their own: those that are a space and a word, from the words' memory."""
        # different sides are different words
        word = [i for i, s in enumerate(sides) if s.startswith(" ") and " " not in s[1:] and self._by_words(s)]
        out = dict(zip(word, self.words.of(pa.array([sides[i][1:] for i in word], pa.large_string()), self._learn).to_pylist(), strict=True))
        rest = [i for i in range(len(sides)) if i not in out]
        out |= zip(rest, (packed(e.ids) for e in self.tok.encode_batch_fast([sides[i] for i in rest], add_special_tokens=False)), strict=True)
        return [out[i] for i in range(len(sides))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        chunks = list(dict.fromkeys(c for cs in cut for c in cs))
        ids = dict(zip(chunks, self.chunks.of(pa.array(chunks, pa.large_string()), self._learn_chunks).to_pylist(), strict=True))
        ends = {c: self._ends(c) for c in chunks}
        seams = sorted({ends[a][1] + ends[b][0] for cs in cut for a, b in zip(cs, cs[1:], strict=False)})
        seam = {s: packed(e.ids) for s, e in zip(seams, self.tok.encode_batch_fast(seams, add_special_tokens=False), strict=True)}
        sides = sorted({x for cs in cut for a, b in zip(cs, cs[1:], strict=False) for x in (ends[a][1], ends[b][0])})
        side = dict(zip(sides, self._sides(sides), strict=True))
        return [self._joined(cs, ids, ends, seam, side) for cs in cut]

    @staticmethod
    def _safe(c: str, i: int) -> bool:
        """Whether a piece surely ends before the space at i."""
        return 0 < i < len(c) - 1 and not (c[i - 1].isspace() or c[i + 1].isspace() or _UNSURE_SPACE.match(c[i - 1]) or _UNSURE_SPACE.match(c[i + 1]))

    @classmethod
    def _ends(cls, c: str, more: int = 0) -> tuple[str, str]:
        """The first and the last words of a chunk, up to places where a piece surely ends; more words each time they didn't agree."""
        head, tail = c.find(" ", 1), c.rfind(" ", 0, max(len(c) - 4, 0))
        while more >= 0 and (head > 0 or tail > 0):
            while head > 0 and not cls._safe(c, head):
                head = c.find(" ", head + 1)
            while tail > 0 and not cls._safe(c, tail):
                tail = c.rfind(" ", 0, tail)
            if not more:
                break
            more -= 1
            head = c.find(" ", head + 1) if head > 0 else head
            tail = c.rfind(" ", 0, tail) if tail > 0 else tail
        return (c[:head] if head > 0 else c), (c[tail:] if tail > 0 else c)

    def _joined(self, cs: list[str], ids: dict, ends: dict, seam: dict, side: dict) -> bytes:
        if not cs:
            return b""
        parts, left, a = [], cs[0], ids[cs[0]]
        for right in cs[1:]:
            b = ids[right]
            self.joins += 1
            h, t = ends[right][0], (ends[left] if left in ends else self._ends(left))[1]
            x, y = (side[t] if t in side else self._whole(t)), side[h]
            both, more = (seam[t + h] if t + h in seam else self._whole(t + h)), 0
            while not (both == x + y and a.endswith(x) and b.startswith(y)) and not (t == left and h == right):
                self.repaired += 1
                more += 1
                h, t = self._ends(right, more)[0], self._ends(left, more)[1]
                x, y, both = self._whole(t), self._whole(h), self._whole(t + h)
            if both == x + y and a.endswith(x) and b.startswith(y):
                if h == right:  # no sure place in it: the next seam looks further back
                    left, a = left + right, a + b
                else:
                    parts.append(a)
                    left, a = right, b
            else:  # both are whole and don't agree: one chunk
                self.repaired += 1
                left, a = left + right, both
        parts.append(a)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False): the tokens' bytes, invalid sequences replaced."""
        return bytes(joined(self.arrow_bytes, pa.array(np.frombuffer(ids, "<u4")))[0]).decode("utf-8", "replace")


def _shown_bytes() -> dict[int, str]:
    """Byte-level vocabularies show printable Latin-1 bytes as themselves and the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make():
        enc = kept(ChunkEncoder, path)

        def some(texts: list[str]) -> list[tuple]:
            return [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()) for ids in enc.encode_all(texts)]

        return some

    return per_text(docs, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string", make, text, together=True)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_bpe": op7_bpe}
