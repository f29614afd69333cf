"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words go into a trie. A depth-first walk gives each node the last token of
the encoding of its prefix: the one vocabulary token that ends there and is
compatible with the last token of the prefix before it. A prefix that several words
share is thus encoded once, and a word's encoding is read off by following the last
tokens backwards. The result equals that of the ``tokenizers`` library.

Null text counts as empty (no ids, empty decoded text). Any length of text works;
repeated rows give repeated results; an empty table gives an empty result; only the
columns named are read, so extra columns and their names don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexspark.llm.common import map_batches, texts

END = "</w>"
#: Words in a generation of a worker's cache, and those that its next task starts with
#: (bounds memory, not results).
CACHE_WORDS, KEPT_WORDS = 400_000, 150_000

#: Texts with other characters than these take the library's own normaliser.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa0-˿]*+")


def _splitter() -> re.Pattern:
    """Words of plain texts in lower case: letters, single digits, runs of others."""

    def of(kind: str) -> str:
        return "".join(re.escape(chr(k)) for k in range(0x300) if unicodedata.category(chr(k))[0] == kind)

    letters, digits = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")


_SPLIT = _splitter()


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 0
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class TrieBpe:
    """Encoder and decoder for a word-end BPE vocabulary file of ``tokenizers``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.vocab = vocab
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self._special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = _byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(spec["model"]["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, k)
            self.halves.setdefault(whole, pair)
            self.made.setdefault(whole, k)
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        #: (left token << 20 | right token) -> whether right may follow left; -1 for none at left.
        self._follows: dict[int, bool] = {}
        # Tokens by their symbols from the last to the first; "" holds the token that begins there.
        self.inner: dict = {}
        self.final: dict = {}
        for s, i in vocab.items():
            node = self.final if s.endswith(END) else self.inner
            for c in reversed(s.removesuffix(END)):
                node = node.setdefault(c, {})
            node[""] = i
        self.raw = {i: i.to_bytes(4, "little") for i in self.strings}
        #: Words (in lower case) of plain texts: their ids, with the generation before, so
        #: frequent ones stay; and (where decoding is asked for) their decoded text.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        #: Words that more than one batch had.
        self.common: set[str] = set()
        #: Words of other texts, in byte symbols.
        self.symbol_words: dict[str, bytes] = {}

    def whole(self, token: int) -> bool:
        """Whether the token's own string encodes to just this token."""
        known = self._whole.get(token)
        if known is None:
            pair = self.halves.get(token)
            known = pair is None or (self.whole(pair[0]) and self.whole(pair[1]) and self.fits(*pair, below=self.made[token]))
            self._whole[token] = known
        return known

    def fits(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge crosses the border while both tokens are being built.

        The last merges inside the two tokens are undone, the later first; a merge
        across the border that ranks before the one undone would have come sooner.
        ``below``: the rank up to which the border has to hold (a token's own merge)."""
        key = (left, right)
        if below is None:
            known = self._fits.get(key)
            if known is not None:
                return known
        rank, made, halves = self.rank, self.made, self.halves
        limit = 1 << 60 if below is None else below
        a, b, ok = left, right, True
        while True:
            k = rank.get((a, b))
            if k is not None and k < limit:
                ok = False
                break
            ka, kb = made.get(a, -1), made.get(b, -1)
            if ka < 0 and kb < 0:
                break
            # At equal ranks the leftmost merge is done first, so the right one is undone first.
            if ka > kb:
                limit, a = ka, halves[a][1]
            else:
                limit, b = kb + 1, halves[b][0]
        if below is None:
            self._fits[key] = ok
        return ok

    def follows(self, left: int, right: int) -> bool:
        """Whether an encoding that ends in ``left`` (-1: an empty one) may go on with ``right``."""
        ok = self.whole(right) and (left < 0 or self.fits(left, right))
        self._follows[left << 20 | right] = ok
        return ok

    def learn(self, words: Iterable[str], out: dict[str, bytes]) -> None:
        """Encode distinct words (as byte symbols) into ``out``.

        Sorted words enter the trie in depth-first order, so the path to the current
        node is all of the trie that has to be kept: for each prefix, its last token and
        where that starts. Only one token that ends at a node can follow the encoding of
        the prefix before it; the shorter ones are tried first."""
        inner, final, known, follows, raw = self.inner, self.final, self._follows.get, self.follows, self.raw
        last: list[int] = [-1]
        start: list[int] = [0]
        before = ""
        for word in sorted(words):
            n = len(word)
            common, stop = 0, min(len(before), n - 1, len(last) - 1)
            while common < stop and before[common] == word[common]:
                common += 1
            del last[common + 1 :], start[common + 1 :]
            for end in range(common + 1, n + 1):
                node, at = (inner if end < n else final), end
                while True:
                    at -= 1
                    node = node[word[at]]
                    token = node.get("")
                    if token is not None:
                        left = last[at]
                        ok = known(left << 20 | token)
                        if ok is None:
                            ok = follows(left, token)
                        if ok:
                            break
                if end < n:
                    last.append(token)
                    start.append(at)
            ids = [raw[token]]
            while at:
                ids.append(raw[last[at]])
                at = start[at]
            ids.reverse()
            out[word] = b"".join(ids)
            before = word

    def _learn_plain(self, missing: set[str]) -> None:
        # Printable ASCII stands for itself.
        other = {w for w in missing if not w.isascii()}
        self.learn(missing - other, self.words)
        if other:
            symbols, found = self.symbols, {}
            spelt = {w: "".join([symbols[b] for b in w.encode()]) for w in other}
            self.learn(set(spelt.values()), found)
            for w, sym in spelt.items():
                self.words[w] = found[sym]

    def _text_of(self, ids: bytes) -> bytes:
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I")]).encode()

    def _encode_hard(self, text: str) -> bytes:
        """Any characters: special tokens are cut out, the library's normaliser and
        splitter make the words, the trie encodes them."""
        ids: list[bytes] = []
        for part in self._special_re.split(text) if self._special_re else [text]:
            if part in self.special:
                ids.append(self.raw[self.special[part]])
            elif part:
                flat = self.library.normalizer.normalize_str(part)
                words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(flat)]
                known = self.symbol_words
                self.learn({w for w in words if w not in known}, known)
                ids += [known[w] for w in words]
        return b"".join(ids)

    def encode_batch(self, batch: list[str], decode: bool = True) -> Iterator[tuple[bytes, bytes]]:
        """Of each text, its ids as little-endian 32-bit integers and (with ``decode``)
        the text that they decode to in UTF-8."""
        if len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
            self.symbol_words.clear()
            self.decoded.clear()
        words, old = self.words, self.old_words
        split: list[list[str] | None] = []
        missing: set[str] = set()
        find = _SPLIT.findall
        for text in batch:
            hard = _PLAIN.fullmatch(text) is None or any(s in text for s in self.special)
            parts = None if hard else find(text.lower())
            split.append(parts)
            if parts:
                missing.update(parts)
        seen = missing & words.keys()
        self.common |= seen
        missing -= seen
        if old:
            kept = missing & old.keys()
            for w in kept:
                words[w] = old[w]
            self.common |= kept
            missing -= kept
        if missing:
            self._learn_plain(missing)
        decoded = self.decoded
        for text, parts in zip(batch, split, strict=True):
            if parts is None:
                ids = self._encode_hard(text)
                yield ids, self._text_of(ids) if decode else b""
                continue
            ids = b"".join([words[w] for w in parts])
            if not decode:
                yield ids, b""
                continue
            try:
                out = b" ".join([decoded[w] for w in parts])
            except KeyError:
                for w in parts:
                    if w not in decoded:
                        decoded[w] = self._text_of(words[w])
                out = b" ".join([decoded[w] for w in parts])
            yield ids, out

    def forget(self) -> None:
        """Give up the caches but for words that several batches had, up to a bound: a
        worker that is used again keeps no more of their memory."""
        known = self.words
        kept = {w: known[w] for w in islice(self.common, KEPT_WORDS) if w in known}
        for cache in (self.words, self.old_words, self.decoded, self.common, self.symbol_words):
            cache.clear()
        self.words = kept

    def encode(self, text: str) -> list[int]:
        raw, _ = next(self.encode_batch([text]))
        return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens' strings, joined by spaces."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def coder(path: str) -> TrieBpe:
    return TrieBpe(path)


def slices(items: list[str], most_chars: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` of about so many characters, at least one item each."""
    begin, size = 0, 0
    for k, x in enumerate(items):
        size += len(x)
        if size >= most_chars:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(items):
        yield begin, len(items)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (binary: little-endian 32-bit), ``decoded`` (string) per row."""

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            rows = texts(batch, text_col)
            for a, b in slices(rows):
                out = list(bpe.encode_batch(rows[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), pa.array([x for x, _ in out], pa.binary()), pa.array([y.decode() for _, y in out], pa.string())],
                    names=[id_col, "ids", "decoded"],
                )
        bpe.forget()

    kind = dict(df.dtypes)[id_col]
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, ids binary, decoded string")


def encode_digests(df: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, and the SHA-256 of the ids and of the decoded text."""

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            rows, n, h, d = texts(batch), [], [], []
            for a, b in slices(rows):
                for ids, decoded in bpe.encode_batch(rows[a:b]):
                    n.append(len(ids) // 4)
                    h.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    return map_batches(df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
