"""Shingles and character grams of whole texts, in Arrow batches: as column expressions the arrays would be
built again for every use, and a substring is looked for from the start of its text."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd

from siltworks.functions.scan import _TOKEN

#: Rows of one result batch.
ROWS = 500_000
#: Characters of a gram, and of the parts of it whose least hash says where it goes. Both are powers of two.
GRAM, PART = 16, 8
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Characters that are hashed at a time.
BLOCK = 1 << 15
PACKED = "bucket int, train boolean, keys binary, sizes binary, chars binary, texts binary"


def normal(text: str) -> str:
    """Lower case, runs of white space as one blank, none around it."""
    return " ".join(text.split()).lower()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _doubled(h: np.ndarray, factor: int, k: int, n: int) -> np.ndarray:
    """From a hash of every k characters that of every n."""
    while k < n:
        h = h[:-k] + h[k:] * np.uint64(pow(factor, k, 1 << 64))
        k *= 2
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="uint32")


def _hashes(codes: np.ndarray, buckets: int = 0) -> tuple[np.ndarray, ...]:
    """128 bits in two arrays of 64 of the gram at every start, and its bucket, where there are some: the same for
    equal grams, mostly the same for neighbours. By blocks that a processor's cache holds."""
    n = max(0, len(codes) - GRAM + 1)
    a, b, at = (np.empty(n, kind) for kind in ("uint64", "uint64", "int32"))
    for i in range(0, n, BLOCK):
        c = codes[i : i + BLOCK + GRAM - 1].astype("uint64") + np.uint64(1)
        part = _doubled(c, _FACTORS[0], 1, PART)
        a[i : i + BLOCK] = _mixed(_doubled(part, _FACTORS[0], PART, GRAM))
        b[i : i + BLOCK] = _mixed(_doubled(c, _FACTORS[1], 1, GRAM))
        if buckets:
            least, k = _mixed(part), 1
            while k < PART:
                least = np.minimum(least[:-k], least[k:])
                k *= 2
            at[i : i + BLOCK] = np.minimum(least[:-1], least[1:]) % np.uint64(buckets)
    return a, b, at


def _starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts joined without a separator, the start and the text of every gram."""
    text = np.repeat(np.arange(len(lengths), dtype="int32"), lengths)
    at = np.flatnonzero(text[: 1 - GRAM] == text[GRAM - 1 :])
    return at, text[at]


def _order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Brings equal grams together, by a and b and then as they come; and where another gram begins. The upper
    bits of a are sorted with the position below them; where they don't tell grams apart, all of it."""
    bits = np.uint64(len(a).bit_length())
    s = np.sort((a >> bits << bits) | np.arange(len(a), dtype="uint64"))
    order = (s & ((np.uint64(1) << bits) - np.uint64(1))).astype("int64")
    new = np.ones(len(a), bool)
    s >>= bits
    new[1:] = s[1:] != s[:-1]
    x, y = a[order], b[order]
    other = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if (other & ~new[1:]).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, new


def _packed(keys: list, texts: list[str], buckets: int, train: bool) -> Iterator[tuple]:
    lengths = np.array([len(x) for x in texts], "int64")
    codes = _codes("".join(texts))
    at, text = _starts(lengths)
    if not train and len(none := np.flatnonzero(lengths < GRAM)):
        yield 0, train, zlib.compress(np.array(keys, "int64")[none].tobytes()), b"", b"", b""
    if not len(at):
        return
    a, b, bucket = _hashes(codes, buckets)
    order, new = _order(a[at], b[at])
    of = text[order]
    once = new.copy()
    once[1:] |= of[1:] != of[:-1]
    if train:
        starts = np.flatnonzero(new)
        held = np.zeros(len(at), "uint8")
        held[order[starts]] = np.minimum(np.add.reduceat(once.astype("int64"), starts), 255)
        kept = np.flatnonzero(held)
        held = held[kept]
    else:
        kept = np.sort(order[once])
    at, text = at[kept], text[kept]
    bucket = bucket[at]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])]))
    size = np.diff(np.append(first, len(at)))
    by = np.argsort(bucket[first], kind="stable")
    first, size = first[by], size[by]
    bucket = bucket[first]

    def rows(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)

    chars = codes[rows(at[first], size + GRAM - 1)]
    ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
    grams_to, chars_to = np.cumsum(size), np.cumsum(size + GRAM - 1)
    if train:
        held = held[rows(first, size)]
    else:
        key = np.array(keys, "int64")[text[first]]
    i = g = c = 0
    for e in ends:
        to, until = grams_to[e - 1], chars_to[e - 1]
        yield (
            int(bucket[i]),
            train,
            b"" if train else zlib.compress(key[i:e].tobytes()),
            zlib.compress(size[i:e].astype("uint32").tobytes()),
            zlib.compress(chars[c:until].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")),
            zlib.compress(held[g:to].tobytes()) if train else b"",
        )
        i, g, c = e, to, until


def packed(batches: Iterator[pd.DataFrame], buckets: int, train: bool) -> Iterator[pd.DataFrame]:
    """The distinct grams of texts, packed by bucket: neighbouring grams mostly share their bucket and are one
    piece of the text there. Those of a text to test with its doc_id (sizes is empty for texts without any),
    those of train texts with the number of texts that hold them."""
    keys, texts, held = [], [], 0

    def out() -> pd.DataFrame:
        return pd.DataFrame(_packed(keys, texts, buckets, train), columns=["bucket", "train", "keys", "sizes", "chars", "texts"])

    for pdf in batches:
        for k, x in zip(pdf["text"] if train else pdf["doc_id"], pdf["text"]):
            keys.append(k)
            texts.append(x)
            held += len(x)
            if held >= 4 * ROWS:
                yield out()
                keys, texts, held = [], [], 0
    if texts:
        yield out()


class _Bucket:
    """What is in a bucket: all of its grams to test, and how many train texts hold each."""

    def __init__(self) -> None:
        self.test, self.train, self.waiting, self.a = [], [], 0, None

    def add(self, row) -> None:
        if not row.train:
            self.test.append(row)
        elif self.test:
            self.train.append(row)
            self.waiting += len(row.chars)
            if self.waiting >= ROWS:
                self.count()

    @staticmethod
    def read(rows: list) -> tuple[np.ndarray, ...]:
        size = np.concatenate([np.frombuffer(zlib.decompress(r.sizes), "uint32") for r in rows]).astype("int64")
        codes = _codes(b"".join(zlib.decompress(r.chars) for r in rows).decode("utf-8", "surrogatepass"))
        at, piece = _starts(size + GRAM - 1)
        return piece, *(h[at] for h in _hashes(codes)[:2])

    def start(self) -> None:
        """The distinct grams to test in order, and for each occurrence its gram and key."""
        keys = [np.frombuffer(zlib.decompress(r.keys), "int64") for r in self.test]
        self.without = np.concatenate([k for k, r in zip(keys, self.test) if not r.sizes] or [np.empty(0, "int64")])
        some = [r for r in self.test if r.sizes]
        if some:
            piece, a, b = self.read(some)
            key = np.concatenate([k for k, r in zip(keys, self.test) if r.sizes])[piece]
        else:
            key, (a, b) = np.empty(0, "int64"), (np.empty(0, "uint64"),) * 2
        order, new = _order(a, b)
        self.key, self.gram = key[order], np.cumsum(new) - 1
        self.a, self.b = a[order[new]], b[order[new]]
        self.texts = np.zeros(len(self.a), "int64")

    def count(self) -> None:
        if self.a is None:
            self.start()
        if self.train and len(self.a):
            _, a, b = self.read(self.train)
            held = np.frombuffer(b"".join(zlib.decompress(r.texts) for r in self.train), "uint8")
            at = np.searchsorted(self.a, a)
            while len(at):
                within = at < len(self.a)
                at, a, b, held = at[within], a[within], b[within], held[within]
                same = self.a[at] == a
                at, a, b, held = at[same], a[same], b[same], held[same]
                hit = self.b[at] == b
                np.add.at(self.texts, at[hit], held[hit])
                at, a, b, held = at[~hit] + 1, a[~hit], b[~hit], held[~hit]
        self.train, self.waiting = [], 0

    def counts(self) -> pd.DataFrame:
        self.count()
        n = self.texts[self.gram]
        x = pd.DataFrame({"doc_id": self.key, "present": (n > 0) & (n <= 2), "distinctive": n <= 2}).groupby("doc_id", sort=False).sum().reset_index()
        return pd.concat([x, pd.DataFrame({"doc_id": self.without, "present": 0, "distinctive": 0})]).astype("int64")


def leaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, present, distinctive from whole buckets of packed(), each with its grams to test ahead of train's."""
    bucket, held = None, _Bucket()
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.bucket != bucket:
                if held.test:
                    yield held.counts()
                bucket, held = row.bucket, _Bucket()
            held.add(row)
    if held.test:
        yield held.counts()


def shingle_counts(batches: Iterator[pd.DataFrame], n: int = 5) -> Iterator[pd.DataFrame]:
    """doc_id, shingle, n: how often each row of n tokens occurs in a text; the whole where there are fewer."""
    for pdf in batches:
        keys, rows, counts = [], [], []
        for k, x in zip(pdf["doc_id"], pdf["text"]):
            t = [w.lower() for w in _TOKEN.findall(x)]
            if t:
                c = Counter(" ".join(t[i : i + n]) for i in range(max(1, len(t) - n + 1)))
                keys += [k] * len(c)
                rows += c.keys()
                counts += c.values()
            if len(rows) >= ROWS:
                yield pd.DataFrame({"doc_id": keys, "shingle": rows, "n": counts})
                keys, rows, counts = [], [], []
        yield pd.DataFrame({"doc_id": keys, "shingle": rows, "n": counts})


#: The structural tokens, numbered before the bytes.
SPECIAL = ["<pad>", "<bos>", "<eos>", "<file_sep>", "<task>", "</task>", "<context>", "</context>", "<answer>", "</answer>", "<fim_prefix>", "<fim_suffix>", "<fim_middle>"]
_SPECIAL = re.compile("(" + "|".join(map(re.escape, sorted(SPECIAL, key=len, reverse=True))) + ")")


def byte_ids(text: str) -> np.ndarray:
    """Structural tokens by their number, everything else byte by byte, above them."""
    parts = [
        np.array([SPECIAL.index(x)], "int32") if i % 2 else np.frombuffer(x.encode("utf-8", "replace"), "uint8").astype("int32") + len(SPECIAL)
        for i, x in enumerate(_SPECIAL.split(text))
    ]
    return np.concatenate(parts)


def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id and ids of every text."""
    for pdf in batches:
        for i in range(0, len(pdf), 500):
            p = pdf.iloc[i : i + 500]
            yield pd.DataFrame({"doc_id": p["doc_id"], "ids": [byte_ids(x) for x in p["text"]]})
