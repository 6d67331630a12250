"""Token ids of a public word-level BPE vocabulary, whole batches at a time, with the tokenizer itself behind them."""

from __future__ import annotations

import numpy as np

from surgeline.llm import kernels as K
from surgeline.llm.shared import doc_chunks

U = np.uint64
#: Words known to a worker; it forgets all of them when there are more.
KNOWN = 1 << 19
#: Bytes of documents that are cut at a time.
CHUNK = 1 << 20

#: Classes of a byte: 0 white space, 1 letters (bytes of Latin-1 letters included), 2 digits, 3 the rest.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 13, 32]] = 0
KIND[[*range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
#: A-Z to a-z, and the second byte of a Latin-1 capital to that of its small letter.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[0x80:0x9F] += 32
#: Bytes that only the tokenizer itself can judge.
ODD = np.zeros(256, bool)
ODD[[*range(0, 9), 11, 12, *range(14, 32), 127]] = True


def odd_docs(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which documents have anything but ASCII text and Latin-1 letters, or the opening of a special token."""
    high = data >= 0x80
    lead = data == 0xC3
    odd = ODD[data] | ((data == 0x97) | (data == 0xB7))
    odd[1:] |= high[1:] & ~lead[1:] & ~lead[:-1]
    if len(odd):
        odd[0] |= bool(high[0] and not lead[0])
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    at = np.flatnonzero(odd)
    return np.searchsorted(at, offs[1:]) > np.searchsorted(at, offs[:-1])


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased texts: runs of one class, single digits, and English endings such as 's as words of their own."""
    n = len(data)
    kind = KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.empty(n, bool)
    start[:1] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    # an apostrophe alone before letters may open an ending
    p = np.flatnonzero((data == 39) & start)
    p = p[p + 1 < n]
    p = p[(kind[p + 1] == 1) & ~edge[p + 1]]
    one = np.isin(data[p + 1], np.frombuffer(b"stmd", np.uint8))
    q = np.minimum(p + 2, n - 1)
    pair = data[p + 1].astype(np.int64) << 8 | np.where(edge[p + 2], 0, data[q])
    two = np.isin(pair, [ord("r") << 8 | ord("e"), ord("v") << 8 | ord("e"), ord("l") << 8 | ord("l")])
    short, rest = p[one | two], (p + np.where(one, 2, 3))[one | two]
    start[short + 1] = False
    inside = rest[(rest < n) & ~edge[rest]]
    start[inside[kind[inside] == 1]] = True
    start |= kind == 2
    mark = start.copy()
    start &= kind > 0
    mark[1:] |= (kind[1:] == 0) & (kind[:-1] > 0)
    at = np.flatnonzero(mark)
    word = start[at]
    return at[word], np.r_[at[1:], n][word]


class WordTokenizer:
    """Ids of texts under a tokenizers file that lower-cases, drops white space and never merges across words.

    Texts of ASCII and Latin-1 letters are cut into words here, by the
    vocabulary's own pattern; each new word is given to the tokenizer once and
    found again by a 64-bit hash. Any other text, and any with a special token's
    opening, goes to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.slots = 1 << 16
        self.hash, self.word = np.zeros(self.slots, U), np.full(self.slots, -1, np.int64)
        self.hashes = np.zeros(0, U)
        self.first, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's word; -1 for new ones."""
        out = np.full(len(h), -1, np.int64)
        at, left = (h & U(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(left):
            word = self.word[at]
            hit = (word >= 0) & (self.hash[at] == h[left])
            out[left[hit]] = word[hit]
            go = (word >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & (self.slots - 1)
        return out

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        # words apart stay apart, so one text of them all has their ids one after another
        got = self.whole.encode(" ".join(words), add_special_tokens=False)
        ids, count = np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(words))
        if len(count) != len(words) or not count.all():
            each = [self.encode_whole(x) for x in words]
            ids, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        self.first = np.r_[self.first, len(self.pool) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.pool = np.r_[self.pool, ids]
        known = len(self.hashes)
        self.hashes = np.r_[self.hashes, hashes]
        if 2 * len(self.hashes) > self.slots:
            while 2 * len(self.hashes) > self.slots:
                self.slots *= 4
            self.hash, self.word, known = np.zeros(self.slots, U), np.full(self.slots, -1, np.int64), 0
        todo = np.arange(known, len(self.hashes))
        at = (self.hashes[todo] & U(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.word[at] < 0
            self.word[at[free]] = todo[free]  # of several that want a slot the last gets it
            won = self.word[at] == todo
            self.hash[at[won]] = self.hashes[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (self.slots - 1)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents (bytes, n + 1 offsets) one after another, and the n + 1 places where each begins."""
        parts, sizes = [], []
        for i, j in doc_chunks(offs, CHUNK):
            ids, size = self.chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            parts.append(ids)
            sizes.append(size)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]

    def chunk(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = odd_docs(raw, offs)
        data = LOWER[raw]
        starts, ends = cut(data, offs)
        doc = np.searchsorted(offs, starts, "right") - 1
        if odd.any():
            plain = ~odd[doc]
            starts, ends, doc = starts[plain], ends[plain], doc[plain]
        h = K.span_hash(K.prefix_hash(data), starts, ends)
        word = self.find(h)
        if (new := np.flatnonzero(word < 0)).size:
            if len(self.hashes) > KNOWN:
                self.forget()
                new = np.arange(len(h))
            hashes, at = np.unique(h[new], return_index=True)
            at = new[at]
            self.learn(hashes, [data[a:b].tobytes().decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            word[new] = self.find(h[new])
        count = self.count[word]
        total = np.bincount(doc, count, len(offs) - 1).astype(np.int64)
        first = self.first[word]
        if len(count) and count.max() > 1:
            before = np.cumsum(count) - count
            ids = self.pool[np.repeat(first - before, count) + np.arange(count.sum())]
        else:
            ids = self.pool[first]
        if odd.any():
            own = {k: self.encode_whole(raw[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")) for k in np.flatnonzero(odd).tolist()}
            at = np.cumsum(total) - total
            out, done = [], 0
            for k, x in own.items():
                out += [ids[done : at[k]], x]
                done = at[k]
                total[k] = len(x)
            ids = np.concatenate([*out, ids[done:]])
        return ids, total


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """The worker's own tokenizer of a file, which its later tasks go on with."""
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
