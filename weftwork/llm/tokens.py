"""Encoding of whole texts with a public tokenizer, each distinct piece of text once per worker.

For a byte-level BPE whose pre-tokenizer is the usual pattern of such vocabularies, a single space
between two characters that aren't white space always starts a new pre-token. Texts are therefore
cut there, the library encodes each distinct piece, and the ids of a text are those of its pieces
in a row: the same ids as the library gives for the whole text. Texts with other uses of spaces, or
with the string of an added token such as ``<|endoftext|>``, go to the library whole. A task keeps a bounded number of pieces.

Ids alone, without offsets, take a shorter way for texts of Latin letters and ASCII without control characters and added
tokens: all their pre-tokens are certain (``pretokens``), and the library's model encodes each distinct one. A worker keeps a
bounded number of these, also from task to task, until one of another kind relieves it.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftwork.llm import pretokens
from weftwork.llm.textbatch import KEPT, buffers, relieve

#: Pieces kept by a task in each of two generations: those not met again in one of them are forgotten.
KEEP = 600_000

#: The value of pieces whose texts go to the library whole; others have four bytes for each token.
_ODD = b"odd"
#: What stands between words that are encoded in one go: a line feed before a space or a letter is one token.
_BETWEEN = "\n"
#: Parts of a piece that are pre-tokens of their own: letters of Latin scripts, digits, marks but for the apostrophe, one line feed.
_PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@[-`{-~]+|\n(?=\S)")
#: Pre-tokens kept by a worker, in a table of 2 to this power; if there are more, it begins anew.
KEEP_TOKENS, _TABLE_BITS = 1_000_000, 21
#: The characters that stand for bytes in the vocabulary.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict(zip([*_PLAIN, *(b for b in range(256) if b not in _PLAIN)], map(chr, [*_PLAIN, *range(256, 512 - len(_PLAIN))]), strict=True))

_loaded: dict[tuple, Encoder] = {}


def load(path: str, offsets: bool = False) -> Encoder:
    """The worker's encoder for the tokenizer file at ``path``."""
    if (path, offsets) not in _loaded:
        _loaded[path, offsets] = Encoder(path, offsets)
    return _loaded[path, offsets]


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian unsigned 32-bit integers.

    With ``offsets``, ``spans(texts)`` gives for each text the first character of each token.
    """

    def __init__(self, path: str, offsets: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: The library's model, for pre-tokens in the vocabulary's alphabet with line feeds between them.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(_ALPHABET[ord(_BETWEEN)], "isolated")
        self.table: pretokens.Table | None = None
        KEPT.append(self._drop)
        #: Strings of added tokens, which the library finds before it splits a text.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.offsets = offsets
        # What stands after a space, and what doesn't; before them the former generation of each.
        self.inner: dict[str, bytes] = {}
        self.leading: dict[str, bytes] = {}
        self.old: tuple[dict, dict] = ({}, {})
        self.line = self.library.encode(_BETWEEN, add_special_tokens=False).ids
        self.mark = self._direct([_BETWEEN])[0]

    def forget(self) -> None:
        """Let go of all pieces: a worker that waits for its next task, maybe of another kind, holds none."""
        self.inner, self.leading, self.old = {}, {}, ({}, {})
        relieve()

    def rest(self) -> None:
        """``forget``, but for the table of pre-tokens, which the next task of this kind may use."""
        self.inner, self.leading, self.old = {}, {}, ({}, {})
        relieve(but=self._drop)

    def _drop(self) -> None:
        self.table = None

    def _direct(self, texts: list[str]) -> list[bytes]:
        if self.offsets:
            return [np.array([a for a, _ in e.offsets], "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str], before: str) -> list[bytes]:
        """The values of parts, encoded as one text with a line feed after each."""
        e = self.library.encode(before + f"{_BETWEEN}{before}".join(words) + _BETWEEN, add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(ids == self.line[0])
        begins = np.append(0, ends[:-1] + 1)
        values = ids
        if self.offsets:
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(before) + 1
            at = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
            values = (at - np.repeat(np.cumsum(sizes) - sizes, ends + 1 - begins)).astype("<u4")
        data = values.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _learn(self, inner: set[str], leading: set[str]) -> None:
        """Encode pieces that aren't known yet. Those that touch other white space are marked as odd.

        Where the pre-tokens of a piece are certain, they are encoded in its place; any other piece is encoded whole.
        """
        plan: list[tuple[dict, str, list[str]]] = []
        todo: tuple[set[str], set[str]] = (set(), set())
        whole: tuple[list[str], list[str]] = ([], [])
        for k, (known, old, pieces) in enumerate(((self.inner, self.old[0], inner), (self.leading, self.old[1], leading))):
            for p in pieces:
                v = old.get(p)
                if v is not None:
                    known[p] = v
                    continue
                if p.isascii() and p.isalpha():
                    todo[k].add(p)
                    continue
                if not p or p[0].isspace() or p[-1].isspace():
                    known[p] = _ODD
                    continue
                parts = _PART.findall(p)
                if sum(map(len, parts)) != len(p):
                    whole[k].append(p)
                    continue
                if len(parts) > 1:
                    plan.append((known, p, parts))
                    todo[1].update(parts[1:])
                todo[k].add(parts[0])
        todo[1].discard(_BETWEEN)
        for known, old, some, direct, before in ((self.inner, self.old[0], todo[0], whole[0], " "), (self.leading, self.old[1], todo[1], whole[1], "")):
            new = []
            for x in some:
                if x not in known:
                    v = old.get(x)
                    if v is None:
                        new.append(x)
                    else:
                        known[x] = v
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                known.update(zip(part, self._words(part, before), strict=True))
            known.update(zip(direct, self._direct([before + x for x in direct]), strict=True))
        get = self.leading.get
        for known, p, parts in plan:
            values = [known[parts[0]], *(self.mark if x == _BETWEEN else get(x) for x in parts[1:])]
            if not self.offsets:
                known[p] = b"".join(values)
                continue
            out, at = [values[0]], len(parts[0]) + (known is self.inner)
            for x, v in zip(parts[1:], values[1:], strict=True):
                out.append((np.frombuffer(v, "<u4") + np.uint32(at)).tobytes() if len(v) > 4 else at.to_bytes(4, "little"))
                at += len(x)
            known[p] = b"".join(out)

    def pieces(self, texts: list[str]) -> list[tuple[list[str], list[bytes] | None]]:
        """For each text its pieces and their values, or None in place of these if it must go whole."""
        if len(self.inner) + len(self.leading) > KEEP:
            self.old = self.inner, self.leading
            self.inner, self.leading = {}, {}
        cut = [t.split(" ") for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.inner)
        first = {c[0] for c in cut if len(c) > 1 or c[0]}.difference(self.leading)
        if new or first:
            self._learn(new, first)
        inner, leading = self.inner.__getitem__, self.leading.__getitem__
        out: list[tuple[list[str], list[bytes] | None]] = []
        for c in cut:
            f = list(map(inner, c))
            f[0] = leading(c[0]) if len(c) > 1 or c[0] else b""
            out.append((c, None if _ODD in f else f))
        for k, t in enumerate(texts):
            if any(x in t for x in self.added):
                out[k] = (out[k][0], None)
        return out

    def _learn_tokens(self, h: np.ndarray, words: list[str]) -> None:
        """Take the ids of new pre-tokens into the table."""
        blank = np.fromiter(map(str.isspace, words), bool, len(words))
        some = [w for w, x in zip(words, blank.tolist(), strict=True) if not x]
        if some:
            text = f"{_BETWEEN.join(some)}{_BETWEEN}".encode().decode("latin-1").translate(_ALPHABET)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            line = ids == self.line[0]
            self.table.add(h[~blank], ids[~line], np.diff(np.flatnonzero(line), prepend=-1) - 1)
        if blank.any():
            values = [np.frombuffer(v, "<u4") for v in self._direct([w for w, x in zip(words, blank.tolist(), strict=True) if x])]
            self.table.add(h[blank], np.concatenate(values), np.array([len(v) for v in values]))

    def _plain_ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of plain texts in a row, number of ids of each)."""
        starts, at = pretokens.cut(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        h = pretokens.hashes(data, starts)
        if self.table is None or self.table.size > KEEP_TOKENS:
            self.table = pretokens.Table(_TABLE_BITS)
        numbers = self.table.find(h)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            raw, where = data.tobytes(), missing[where]
            ends = np.append(starts[1:], len(data))[where]
            self._learn_tokens(new, [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends.tolist(), strict=True)])
            numbers[missing] = self.table.find(h[missing])
        ids, counts = self.table.expand(numbers)
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[at]
        return ids, np.diff(total)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); a null text has none."""
        data, offs = buffers(texts)
        plain = pretokens.plain(data, offs)
        for x in self.added:
            plain &= ~pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._plain_ids(data, offs)
        ids, counts = self._plain_ids(*buffers(texts.filter(pa.array(plain))))
        others = [np.frombuffer(v, "<u4") for v in self._by_pieces(pc.fill_null(texts, "").filter(pa.array(~plain)).to_pylist())]
        out = np.zeros(len(plain), np.int64)
        out[plain], out[~plain] = counts, [len(v) for v in others]
        parts, others = iter(np.split(ids, np.cumsum(counts)[:-1])), iter(others)
        return np.concatenate([next(parts) if p else next(others) for p in plain.tolist()]), out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.offsets or not texts:
            return self._by_pieces(texts)
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        found = self.pieces(texts)
        whole = iter(self._direct([t for t, (_, f) in zip(texts, found, strict=True) if f is None]))
        return [next(whole) if f is None else b"".join(f) for _, f in found]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        found = self.pieces(texts)
        whole = iter(self._direct([t for t, (_, f) in zip(texts, found, strict=True) if f is None]))
        out = []
        for c, f in found:
            if f is None:
                out.append(np.frombuffer(next(whole), "<u4").astype(np.int64))
                continue
            # A piece after the first is encoded with the space before it, at which its offsets begin.
            at = np.fromiter(map(len, c), np.int64, len(c))
            at += 1
            np.cumsum(at, out=at)
            at[1:] = at[:-1] - 1
            at[0] = 0
            values = b"".join(f)
            x = np.frombuffer(values, "<u4")
            # Most pieces are one token, whose offset is the piece's.
            out.append(at if len(x) == len(f) and not x.any() else x + np.repeat(at, np.fromiter(map(len, f), np.int64, len(f)) >> 2))
        return out
