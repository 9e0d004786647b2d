"""BPE encoding and decoding by speculation.

For each word a greedy longest match proposes tokens. A proposal is the exact encoding if and only if every
pair of neighbours is compatible, that is, encodes to itself; a vectorised check tests all pairs of a batch
at once and remembers them. Only words with a failing pair are merged exactly, rank by rank.

Words repeat, so each worker keeps a bounded table of the words it has met; a full table is emptied. Pieces of more
than ``LONG_PIECE`` bytes are merged exactly at once, as a failing piece would be: their ids are the same either way.
Defined results: a null text counts as empty and has no tokens; very long texts are taken whole; repeated
rows are encoded each; an empty table gives an empty one; columns besides id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, give_back, word_steps

#: Words that a worker remembers before it forgets those that it hasn't met lately; longer words are not remembered.
CACHE_WORDS, CACHE_BYTES = 600_000, 64
#: Words in the table of hashes, and bytes of text between two additions to it.
STORE_WORDS, STORE_STEP = 400_000, 1 << 20
#: Texts that are encoded together, so that the vectorised steps have many words.
BATCH = 1024
#: Longer pieces are merged one at a time with a heap.
LONG_PIECE = 64
_SUFFIX = "</w>"
_NONE = np.int64(1 << 60)


def tokenizer_path(path: str | None = None) -> str:
    """A tokenizer file; by default the installed public 49k vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Lookup:
    """A fixed map from integers to integers with vectorised reads (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(len(keys) * 5).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask, self.keys, self.values = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], missing)
        again = np.flatnonzero((found != keys) & (found >= 0))
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            found = self.keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (found >= 0)]
        return out


class _Store:
    """Ids of the words that a worker has met, by the word's hash. New words go to a small sorted list that now and then joins the large one."""

    RECENT = 1 << 15

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.old = self.new = (np.empty(0, np.uint64), np.empty(0, np.int32))
        self.start, self.flat = np.zeros(1, np.int64), [np.empty(0, np.uint32)]

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.new[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        for own, slots in (self.old, self.new):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                out[hit] = slots[at[hit]]
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        slots = (len(self.start) - 1 + np.arange(len(keys))).astype(np.int32)
        self.new = self._joined(self.new, (keys, slots))
        if len(self.new[0]) > self.RECENT:
            self.old, self.new = self._joined(self.old, self.new), (np.empty(0, np.uint64), np.empty(0, np.int32))
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat.append(np.frombuffer(b"".join(ids), "<u4"))

    @staticmethod
    def _joined(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and where each word's begin (with the end)."""
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        begin, sizes = self.start[slots], self.start[slots + 1] - self.start[slots]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[0][np.repeat(begin - bounds[:-1], sizes) + np.arange(int(bounds[-1]))], bounds


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file. A piece is the UTF-8 of one pre-token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        chars = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = token
        self.inner, self.end = np.array([vocab[c] for c in chars]), np.array([vocab[c + _SUFFIX] for c in chars])
        # rank: order in which tokens come to be; base symbols have none and split into themselves
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(spec["model"]["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merges.setdefault((x, y), (k, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        keys = np.array([x << 20 | y for x, y in self.merges], np.int64)
        self.pairs = _Lookup(keys, np.array([k << 20 | z for k, z in self.merges.values()], np.int64))
        self._build_trie(vocab)
        self.words: dict[str, dict[bytes, bytes]] = {"ids": {}, "text": {}, "tokens": {}}
        self.met: dict[str, set[bytes]] = {"ids": set(), "text": set()}
        self.store = _Store()
        self.ends_sentence = np.array([bool(re.search(r"[.!?]+</w>$", t)) for t in self.text_of])
        self.id_text = [b"%d" % i for i in range(size)]
        self.token_text = [t.encode() for t in self.text_of]

    @staticmethod
    @cache
    def load(path: str) -> WordBpe:
        out = WordBpe(path)
        give_back()
        return out

    @cached_property
    def library(self):
        """The library's tokenizer, for words that its normaliser may change."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _build_trie(self, vocab: dict[str, int]) -> None:
        """Tokens by their bytes. Left out are those that merging their own bytes doesn't give."""
        tokens = [(bytes(self.byte_of[c] for c in t.removesuffix(_SUFFIX)), t.endswith(_SUFFIX), i) for t, i in vocab.items()]
        flat, first = self._symbols([t for t, _, _ in tokens], np.array([e for _, e, _ in tokens]))
        merged, places = self.merge(flat, first)
        child: dict[int, int] = {}
        inner, end = [-1], [-1]
        for k, (text, is_end, i) in enumerate(tokens):
            if places[k + 1] - places[k] != 1 or merged[places[k]] != i:
                continue
            node = 0
            for b in text:
                if (to := child.get(node << 8 | b)) is None:
                    to = child[node << 8 | b] = len(inner)
                    inner.append(-1)
                    end.append(-1)
                node = to
            (end if is_end else inner)[node] = i
        self.child = _Lookup(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        self.inner_at, self.end_at = np.array(inner), np.array(end)

    def _symbols(self, pieces: list[bytes], ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Base symbols of pieces end to end, and where each piece begins."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        flat = self.inner[data]
        last = first[1:] - 1 if ends is None else (first[1:] - 1)[ends]
        flat[last] = self.end[data[last]]
        return flat, first

    # the three steps: propose, verify, merge

    def propose(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all pieces side by side: tokens, the piece of each, and the pieces that it can't cover."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        stop = np.cumsum([len(p) for p in pieces])
        which = np.arange(len(pieces))
        at = stop - [len(p) for p in pieces]  # where the walk is
        node, best, after = np.zeros_like(at), np.full_like(at, -1), at.copy()
        out_piece, out_token, failed = [], [], np.zeros(len(pieces), dtype=bool)
        while len(which):
            node = self.child.get(node << 8 | data[at], -1)
            alive = node >= 0
            at = at + 1
            whole = alive & (at == stop)
            ended = np.where(whole, self.end_at[node], -1)
            done = ended >= 0
            token = np.where(alive & ~whole, self.inner_at[node], -1)
            best, after = np.where(token >= 0, token, best), np.where(token >= 0, at, after)
            cut = ~done & (~alive | whole)  # the walk goes no farther: take the longest match
            stuck = cut & (best < 0)
            failed[which[stuck]] = True
            take = cut & ~stuck
            emit = done | take
            out_piece.append(which[emit])
            out_token.append(np.where(done, ended, best)[emit])
            at, node, best = np.where(cut, after, at), np.where(cut, 0, node), np.where(cut, -1, best)
            go = ~done & ~stuck
            which, at, node, best, after, stop = which[go], at[go], node[go], best[go], after[go], stop[go]
        piece, token = np.concatenate(out_piece), np.concatenate(out_token)
        order = np.argsort(piece, kind="stable")
        return token[order], piece[order], failed

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses the border between them before they are whole."""
        ok, still = np.ones(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(still):
            crossing = (self.pairs.get(a << 20 | b, _NONE) >> 20) < limit
            ok[still[crossing]] = False
            ra, rb = self.rank[a], self.rank[b]
            later_a = ra > rb  # the token made later is undone first
            go = ~crossing & (np.where(later_a, ra, rb) >= 0)
            # a merge of the same rank as the right token's own stands left of it, so it comes first
            limit = np.where(later_a, ra, rb + 1)[go]
            a, b = np.where(later_a, self.right[a], a)[go], np.where(later_a, b, self.left[b])[go]
            still = still[go]
        return ok

    def merge(self, flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all pieces side by side: in each the lowest rank first, the leftmost of equals."""
        n = len(first) - 1
        piece = np.repeat(np.arange(n), np.diff(first))
        done_piece, done_token = [], []
        while len(flat):
            found = np.full(len(flat), _NONE)
            found[:-1] = np.where(piece[1:] == piece[:-1], self.pairs.get(flat[:-1] << 20 | flat[1:], _NONE), _NONE)
            begin = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.repeat(np.minimum.reduceat(found, begin), np.diff(np.concatenate([begin, [len(flat)]])))
            over = least == _NONE
            done_piece.append(piece[over])
            done_token.append(flat[over])
            at = np.flatnonzero((found == least) & ~over)
            at = at[np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])] if len(at) else at
            flat[at] = found[at] & ((1 << 20) - 1)
            keep = ~over
            keep[at + 1] = False
            flat, piece = flat[keep], piece[keep]
        piece, token = np.concatenate(done_piece or [np.empty(0, np.int64)]), np.concatenate(done_token or [np.empty(0, np.int64)])
        order = np.argsort(piece, kind="stable")
        return token[order], np.searchsorted(piece[order], np.arange(n + 1))

    def merge_long(self, piece: bytes) -> list[int]:
        """Exact merging of one long piece, in n log n."""
        ids: list[int] = [*self.inner[list(piece[:-1])].tolist(), int(self.end[piece[-1]])] if len(piece) > 1 else [int(self.end[piece[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heap = [(k, i, x, y, z) for k, z, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := self.merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces, little-endian and unsigned in 32 bits."""
        out = {p: np.array(self.merge_long(p), "<u4").tobytes() for p in pieces if len(p) > LONG_PIECE}
        pieces = [p for p in pieces if len(p) <= LONG_PIECE]
        if not pieces:
            return out
        token, piece, failed = self.propose(pieces)
        inside = np.flatnonzero(piece[1:] == piece[:-1])
        failed[piece[inside[~self.compatible(token[inside], token[inside + 1])]]] = True
        first = np.searchsorted(piece, np.arange(len(pieces) + 1))
        good = ~failed[piece]
        ids = [token[good]]
        sizes, right = np.diff(first)[~failed], np.flatnonzero(~failed)
        if failed.any():
            wrong = np.flatnonzero(failed)
            token, places = self.merge(*self._symbols([pieces[k] for k in wrong.tolist()]))
            ids.append(token)
            sizes, right = np.concatenate([sizes, np.diff(places)]), np.concatenate([right, wrong])
        raw, stop = np.concatenate(ids).astype("<u4").tobytes(), np.cumsum(4 * sizes).tolist()
        out.update(zip([pieces[k] for k in right.tolist()], [raw[i:j] for i, j in zip([0, *stop], stop, strict=False)], strict=True))
        return out

    # words of a text

    def split(self, raw: bytes) -> list[bytes | int]:
        """A word without ASCII white space as pieces; a special token stands as its id."""
        if raw.isalpha():  # ASCII letters only
            return [raw.lower()]
        if raw[:-1].isalpha() and raw[-1:] in b".,;:!?":
            return [raw[:-1].lower(), raw[-1:]]
        word = raw.decode()
        if self.split_special and "<|" in word and self.split_special.search(word):
            return [y for x in self.split_special.split(word) if x for y in ([self.special[x]] if x in self.special else self.split(x.encode()))]
        if word.isprintable() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word):  # Latin letters
            word = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            if word.isalpha():
                return [word.encode()]
            if word[:-1].isalpha() and word[-1] in ".,;:!?":
                return [word[:-1].encode(), word[-1:].encode()]
            return [x.encode() for x in self.pattern.findall(word)]
        return [bytes(self.byte_of[c] for c in x) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words."""
        split = [self.split(w) for w in words]
        pieces = set().union(*split)
        special = {p for p in pieces if isinstance(p, int)}
        found = self.encode_pieces(list(pieces - special)) | {p: struct.pack("<I", p) for p in special}
        return {w: found[ps[0]] if len(ps) == 1 else b"".join([found[p] for p in ps]) for w, ps in zip(words, split, strict=True)}

    def _known(self, kind: str, texts: list[bytes]) -> list[list[bytes]]:
        """Words of the texts; all of them are then in the tables of that kind."""
        split = [t.split() for t in texts]
        known, met = self.words[kind], self.met[kind]
        here = set().union(*split)
        tables = [known, self.words["tokens"]] if kind == "text" else [known]
        if len(known) > CACHE_WORDS:
            stay = {w for w in met if len(w) <= CACHE_BYTES} if len(met) < CACHE_WORDS // 2 else set()
            for table in tables:
                kept = {w: table[w] for w in stay}
                table.clear()
                table.update(kept)
            met.clear()
        met |= here
        new = self.learn([w for w in here if w not in known])
        if kind == "ids":
            known.update(new)
        else:
            for w, raw in new.items():
                ids = memoryview(raw).cast("I").tolist()
                known[w] = b" ".join([self.id_text[i] for i in ids])
                tables[1][w] = b" ".join([self.token_text[i] for i in ids])
        return split

    def encode_bytes(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian and unsigned in 32 bits."""
        split = self._known("ids", texts)
        get = self.words["ids"].__getitem__
        return [b"".join(map(get, words)) for words in split]

    def digests(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """Number of ids, and sha256 of the ids as text and of the decoded text."""
        out, split = [], self._known("text", texts)
        ids, tokens = self.words["text"].__getitem__, self.words["tokens"].__getitem__
        for words in split:
            joined, text = b" ".join(filter(None, map(ids, words))), b" ".join(filter(None, map(tokens, words)))
            out.append((joined.count(b" ") + 1 if joined else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out

    def encode_steps(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of a binary column: (first row, end row, ids of all its texts, where each text begins).

        Words are looked up by their 64-bit hash, side by side; only new ones become Python objects. The hash
        is trusted: two different words of a worker's table share it once in some 40 million tables.
        """
        for row, end, words in word_steps(column, fold_case=False, limit=STORE_STEP):
            types, at, which = np.unique(words.hashes, return_index=True, return_inverse=True)
            slot = self.store.find(types)
            new = np.flatnonzero(slot < 0)
            if len(new):
                if len(self.store) + len(new) > STORE_WORDS:
                    self.store.forget()
                    new = np.arange(len(types))
                raw, begin = words.data.tobytes(), words.starts[at[new]]
                texts = [raw[a:b] for a, b in zip(begin.tolist(), (begin + words.lengths[at[new]]).tolist(), strict=True)]
                found = self.learn(texts)
                self.store.add(types[new], [found[t] for t in texts])
                slot = self.store.find(types)
            ids, bounds = self.store.ids(slot[which])
            yield row, end, ids, bounds[words.first]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: this vocabulary names no decoder."""
        return " ".join(self.text_of[i] for i in ids)

    def sentence_ends(self, ids: bytes) -> np.ndarray:
        """Places after the tokens that end a sentence."""
        return np.flatnonzero(self.ends_sentence[np.frombuffer(ids, "<u4")]) + 1


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def encode(text: Column, tokenizer: str | None = None) -> Column:
    """Token ids of a text."""
    path = tokenizer_path(tokenizer)

    @arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        bpe, out = WordBpe.load(path), []
        for i in range(0, len(column), BATCH):
            out += [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_bytes(column.slice(i, BATCH).to_pylist())]
        return pa.array(out, pa.list_(pa.int32()))

    return run(as_bytes(text))


def decode(ids: Column, tokenizer: str | None = None) -> Column:
    """Text of token ids, special tokens included."""
    path = tokenizer_path(tokenizer)

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        bpe = WordBpe.load(path)
        return pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())

    return run(ids)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Digests of the encoding and of what it decodes to. The ids never leave the worker, so no row is larger than its text."""
    path = tokenizer_path(tokenizer)

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(column: pa.Array) -> pa.Array:
        bpe, out = WordBpe.load(path), []
        for i in range(0, len(column), BATCH):
            out += bpe.digests(column.slice(i, BATCH).to_pylist())
        give_back()
        parts = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.string()), pa.array(parts[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(as_bytes(F.col(text))).alias("coded")).select("doc_id", "coded.*")
