"""Token ids of whole texts, and prefix-sharing trie traversal for BPE (operators 6, 5, 7).

``TrieBpe`` encodes with byte-pair merges read from a tokenizer file:

* A merge-derived BPE encoding is determined by its last token: the encoding
  of a prefix is the encoding of a shorter prefix plus one token, and a token
  sequence is an encoding exactly if every adjacent pair is (``_adjacent``).
* Distinct words go into a trie.  A depth-first walk keeps, per depth, the
  last token of the prefix that ends there, so a prefix shared by many words is
  encoded once.  In code the trie is its sorted word list: the walk backs up
  to the common prefix with the previous word.

Texts are cut at ASCII white space; a chunk's ids do not depend on its
neighbours, because the normalizer and the splitting pattern never join text
across white space.  Each Python worker keeps the ids of recently used chunks
in a two-generation cache of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Bytes of one generation of a worker's cache, and what an entry takes beside its chunk and ids.
_CACHE_BYTES = 64 << 20
_ENTRY_BYTES = 180
_PAIRS = 2_000_000
_SINGLE = 1 << 60
#: Stands for the end of a word; byte-level signs are all below U+0144.
_END = "\uffff"
#: The texts whose normal form is their lower case, the tokenizer's splitting pattern on
#: them, and the signs that byte-level texts have for bytes that are not printable in Latin-1.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
_SIGNS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def plain_words(chunk: str) -> list[str] | None:
    """The words of a chunk in byte-level signs, for Latin-1 letters and printable ASCII; None for other chunks."""
    if chunk.isalpha() and chunk.isascii():
        return [chunk.lower()]
    if not _PLAIN(chunk):
        return None
    words = _PIECES(chunk.lower())
    return words if chunk.isascii() else [w.encode("utf-8").decode("latin-1").translate(_SIGNS) for w in words]


class TrieBpe:
    """Encoder of a word-level BPE tokenizer file (end-of-word suffix, byte-level symbols)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE model with an end-of-word suffix is required")
        lib = Tokenizer.from_file(path)
        self.normalize, self.split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.specials = specials
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.names = {i: t for t, i in {**self.vocab, **specials}.items()}
        self._tables([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])

    def _tables(self, merges: list[tuple[str, str]]) -> None:
        vocab = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = (vocab[a], vocab[b])
            self.rank.setdefault(pair, r)
            parts.setdefault(vocab[a + b], (*pair, r))
        # edge pieces of a token over the time of its merges, with the rank that ends each piece
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for t in vocab.values():
            for side, out in ((1, self.right), (0, self.left)):
                spine, node, end = [], t, _SINGLE
                while True:
                    spine.append((node, end))
                    if node not in parts:
                        break
                    end = parts[node][2]
                    node = parts[node][side]
                out[t] = spine
        # tokens that encode to themselves, by their text with the end of word as one sign;
        # and the greatest length of a token by its last two signs
        self.by_text: dict[str, int] = {}
        self.reach: dict[str, int] = {}
        for text, t in vocab.items():
            key = self._key(text)
            if self._merged(key) == [t]:
                self.by_text[key] = t
                for tail in (key[-2:], key[-1:]):
                    self.reach[tail] = max(self.reach.get(tail, 0), len(key))
        self._pairs: dict[int, bool] = {}

    def _key(self, text: str) -> str:
        body = text.removesuffix(self.suffix)
        return body + _END if body and body != text else text

    def _merged(self, key: str) -> list[int]:
        """Plain merging, lowest rank first, for the few thousand letters of the vocabulary itself."""
        symbols = list(key.removesuffix(_END))
        if key.endswith(_END):
            symbols[-1] += self.suffix
        ids = [self.vocab[x] for x in symbols]
        while len(ids) > 1:
            r, at = min((self.rank.get(p, _SINGLE), i) for i, p in enumerate(zip(ids, ids[1:])))
            if r == _SINGLE:
                break
            ids[at:at + 2] = [self.vocab[self.names[ids[at]] + self.names[ids[at + 1]]]]
        return ids

    def _adjacent(self, u: int, t: int) -> bool:
        """Whether ``[u, t]`` is the encoding of its own text.

        Merges happen in order of rank.  Two edge pieces meet if a merge of
        them ranks before the merges that consume either (at equal rank the
        pair further left goes first).
        """
        rank = self.rank
        for a, end_a in self.right[u]:
            for b, end_b in self.left[t]:
                r = rank.get((a, b))
                if r is not None and r < end_a and r <= end_b:
                    return False
        return True

    def _last_token(self, text: str, size: int, last: list[int]) -> tuple[int, int]:
        """The last token of the encoding of ``text[:size]`` and where it begins; ``last``: of each shorter prefix."""
        by_text, pairs = self.by_text, self._pairs
        for begin in range(max(0, size - self.reach.get(text[max(0, size - 2):size], 1)), size):
            t = by_text.get(text[begin:size])
            if t is not None:
                if not begin:
                    return t, 0
                pair = last[begin] << 20 | t
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > _PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self._adjacent(last[begin], t)
                if fits:
                    return t, begin
        raise ValueError(f"no token ends {text[:size]!r}")

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of distinct words (byte-level signs, without suffix), by a depth-first walk over their trie."""
        out: dict[str, list[int]] = {}
        path = ""
        last, back = [-1], [0]      # by depth: the last token of the prefix that ends there, and its beginning
        for word in sorted(words):
            inner = len(word) - 1
            keep, most = 0, min(max(len(path) - 1, 0), inner)
            while keep < most and path[keep] == word[keep]:
                keep += 1
            del last[keep + 1:], back[keep + 1:]
            for end in range(keep + 1, inner + 1):
                t, begin = self._last_token(word, end, last)
                last.append(t)
                back.append(begin)
            path = word
            t, at = self._last_token(word + _END, inner + 2, last)
            ids = [t]
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            out[word] = ids
        return out

    def encode_chunks(self, chunks: list[str]) -> dict[str, list[int]]:
        """Ids of distinct chunks of text."""
        plan, words = {}, set()
        for chunk in chunks:
            pieces = self.special_pattern.split(chunk) if self.special_pattern and "<|" in chunk else (chunk,)
            items: list = []
            for piece in pieces:
                if piece in self.specials:
                    items.append(self.specials[piece])
                elif piece:
                    found = plain_words(piece)
                    if found is None:
                        found = [w for w, _ in self.split(self.normalize(piece))]
                    words.update(found)
                    items.extend(found)
            plan[chunk] = items
        ids = self.encode_words(words)
        return {c: [i for x in items for i in ((x,) if isinstance(x, int) else ids[x])] for c, items in plan.items()}

    def decode(self, ids) -> str:
        """Token strings joined by blanks, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, ids))


class LibraryBpe:
    """The tokenizers library itself, chunk by chunk (operators 5 and 7)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.merge = self.lib.model.tokenize
        self.signs = [i.to_bytes(4, "little") for i in range(self.lib.get_vocab_size())]

    def chunk_bytes(self, chunk: bytes) -> bytes:
        """Ids of one chunk: a plain one goes to the library's model word by word, another through the whole library."""
        text, signs, merge = chunk.decode("utf-8"), self.signs, self.merge
        words = plain_words(text) if "<|" not in text else None
        if words is None:
            return b"".join([signs[i] for i in self.lib.encode(text, add_special_tokens=False).ids])
        if len(words) == 1:
            return b"".join([signs[t.id] for t in merge(words[0])])
        return b"".join([signs[t.id] for w in words for t in merge(w)])


class _Generation(dict):
    """Ids of recently used chunks; what it lacks comes from the generation before it or from the engine."""

    def __init__(self, before: dict, engine):
        super().__init__()
        self.before, self.engine, self.size = before, engine, 0

    def add(self, chunk: bytes, ids: bytes) -> None:
        self[chunk] = ids
        self.size += len(chunk) + len(ids) + _ENTRY_BYTES

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.engine.chunk_bytes(chunk)
        self.add(chunk, ids)
        return ids


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit arrays, through a chunk cache of two generations.

    ``cache_bytes`` bounds one generation, up to the chunks that one text adds to it.
    """

    def __init__(self, engine, cache_bytes: int = _CACHE_BYTES):
        self.engine, self.limit = engine, cache_bytes
        self.young = _Generation({}, engine)

    def _age(self) -> None:
        if self.young.size > self.limit:
            self.young.before = {}
            self.young = _Generation(self.young, self.engine)

    def join(self, chunks: list) -> bytes:
        """Ids of a text's chunks, side by side."""
        ids = b"".join(map(self.young.__getitem__, chunks))
        self._age()
        return ids

    def encode_bytes(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text, side by side."""
        return self.join(text.split())

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """One array per UTF-8 text."""
        if hasattr(self.engine, "chunk_bytes"):
            return [np.frombuffer(self.encode_bytes(t), dtype="<u4") for t in texts]
        return [np.frombuffer(ids, dtype="<u4") for ids in self._by_trie(texts)]

    def _by_trie(self, texts: list[bytes]) -> list[bytes]:
        """An engine that shares prefixes gets the new chunks of many texts at once."""
        out: list[bytes] = []
        held: list[list[bytes]] = []                # chunks of texts not yet put out
        fresh: set[bytes] = set()

        def flush():
            names = [c.decode("utf-8") for c in fresh]
            got = self.engine.encode_chunks(names)
            for n in names:
                self.young.add(n.encode("utf-8"), _bytes(got[n]))
            fresh.clear()
            out.extend(b"".join(map(self.young.__getitem__, chunks)) for chunks in held)
            held.clear()
            self._age()

        pending = 0
        for text in texts:
            chunks = text.split()
            for c in set(chunks):
                if c not in self.young:
                    known = self.young.before.get(c)
                    if known is None:
                        fresh.add(c)
                    else:
                        self.young.add(c, known)
            held.append(chunks)
            pending += len(chunks)
            if len(fresh) > 20_000 or pending > 500_000:
                flush()
                pending = 0
        flush()
        return out


_encoders: dict[tuple[type, str], TextEncoder] = {}


def encoder(kind: type, path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file (one per Python process)."""
    if (kind, path) not in _encoders:
        _encoders.clear()
        _encoders[(kind, path)] = TextEncoder(kind(path))
    return _encoders[(kind, path)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def give_back() -> None:
    """Return freed memory to the system: a worker goes on to other tasks, and its executor counts it."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def row_slices(batches, most_bytes: int = 4 << 20, encodes: bool = False):
    """Arrow record batches cut into slices of at most about ``most_bytes`` (one row at least).

    A function that does not encode (``encodes``) drops the encoder that an earlier task left in the worker.
    """
    if not encodes:
        _encoders.clear()
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, int(rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    give_back()
