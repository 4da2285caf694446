"""Exact tokenizer runs that encode every distinct space-delimited piece once.

Both vocabularies never join characters across a single space that stands
between two non-space characters, so a text's ids are the ids of its pieces in a
row.  Pieces repeat far more often than texts, so a worker remembers them.
"""

from __future__ import annotations

import gc
import os
import re
import unicodedata
from array import array
from unicodedata import is_normalized

import numpy as np

# Bytes above ASCII that the byte-level alphabet moves beyond Latin-1: 127 to 160 and 173, in order after the 33 of ASCII.
_BYTE_SYMBOLS = {b: 256 + 33 + i for i, b in enumerate([*range(127, 161), 173])}
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_RAW, _MARK = "\x01", "\x02"  # before a piece that no space precedes, before a mark split off
#: Pieces that a worker remembers; beyond it only those of few characters stay.
CACHE_PIECES, SHORT = 700_000, 8


class Encoder:
    """Texts to little-endian ids of one tokenizer file.

    spaces="lead": a space belongs to the piece after it (byte-level BPE).
    spaces="drop": white space only separates (BPE with word ends).

    Pieces end at spaces, and before a comma or full stop that follows a letter
    or digit and ends its run; both vocabularies always split there.  A text
    where such a mark follows another one falls back to splits at spaces.

    As in a plain call of the library, the string of a special token in a text
    gives that token's id; such a text is encoded as a whole.
    """

    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.lead = spaces == "lead"
        self.fine: dict[str, bytes] = {}
        self.odd: dict[str, bytes | None] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        gc.disable()  # many short-lived strings, no cycles
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def forget(self) -> None:
        """Give the memory of known pieces back: a worker lives on after its task and may serve other stages."""
        self.fine, self.odd = {}, {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if special := [k for k, t in enumerate(texts) if self.special.search(t)]:
            whole = iter(self.model.encode_batch_fast([texts[k] for k in special], add_special_tokens=False))
            rest = iter(self._encoded([t for t in texts if not self.special.search(t)]))
            return [array(self.code, next(whole).ids).tobytes() if k in special else next(rest) for k in range(len(texts))]
        for known in (self.fine, self.odd):
            if len(known) > CACHE_PIECES:
                short = {p: ids for p, ids in known.items() if len(p) <= SHORT}
                known.clear()
                known.update(short if len(short) < CACHE_PIECES // 2 else {})
        split = self._fine_lead if self.lead else self._fine_drop
        pieces = [split(t) for t in texts]
        fine, odd = self.fine, self.odd
        found = [list(map(fine.get, s)) for s in pieces]
        holes = [[i for i, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        new = {s[i] for s, h in zip(pieces, holes) for i in h}
        good = [p for p in new if p not in odd and self._fit_fine(p)]
        self._learn(fine, good)
        self._learn_odd(new.difference(good))
        for k, (s, f, h) in enumerate(zip(pieces, found, holes)):
            rest = False
            for i in h:
                ids = f[i] = fine.get(s[i])
                rest |= ids is None
            if rest and not self._fill_odd(texts[k], s, f, h):
                found[k] = [self._split_at_spaces(texts[k])]
        return [b"".join(f) for f in found]

    def _learn_odd(self, pieces) -> None:
        """Pieces that don't end in a letter or digit: None where even the split at spaces isn't a boundary."""
        new = [p for p in pieces if p not in self.odd]
        good = [p for p in new if self._fit_coarse(p)]
        self.odd.update(dict.fromkeys(set(new).difference(good)))
        self._learn(self.odd, good)

    def _fill_odd(self, text: str, pieces: list[str], found: list, holes: list[int]) -> bool:
        """Fill in odd pieces, which are whole unless a mark split off follows one; False if the text needs fewer splits."""
        last = len(pieces) - 1
        for i in holes:
            if found[i] is None:
                ids = self.odd.get(pieces[i])
                if ids is None or i < last and pieces[i + 1][:1] == _MARK:
                    return False
                found[i] = ids
        return True

    def _split_at_spaces(self, text: str) -> bytes:
        pieces = self._coarse_lead(text) if self.lead else self._coarse_drop(text)
        self._learn_odd({p for p in pieces if p not in self.fine})
        ids = [self.odd[p] if (i := self.fine.get(p)) is None else i for p in pieces]
        return self._whole(text) if None in ids else b"".join(ids)

    def _learn(self, known: dict, pieces: list[str]) -> None:
        """Ids of new pieces: those of letters only are single words for both tokenizers and go straight to the model."""
        code, words, rest = self.code, [], []
        for p in pieces:
            (words if p.isalpha() and (self.lead or p.isascii() or p == p.lower() and is_normalized("NFC", p)) else rest).append(p)
        mark, merge = "Ġ" if self.lead else "", self.model.model.tokenize
        known.update((p, array(code, [t.id for t in merge(mark + self._symbols(p))]).tobytes()) for p in words)
        if rest:
            before = " " if self.lead else ""
            found = self.model.encode_batch_fast([p[1:] if p[:1] in (_RAW, _MARK) else before + p for p in rest], add_special_tokens=False)
            known.update(zip(rest, [array(code, e.ids).tobytes() for e in found]))

    def _symbols(self, word: str) -> str:
        """The byte-level alphabet's spelling of a word."""
        if word.isascii():
            return word if self.lead else word.lower()
        return word.encode().decode("latin-1").translate(_BYTE_SYMBOLS)

    @staticmethod
    def _fine_lead(text: str) -> list[str]:
        if not text or _RAW in text or _MARK in text:
            return [_RAW] if text else []
        cut = text.replace(", ", " \x02, ").replace(". ", " \x02. ").replace(".\n", " \x02. \x02\n \x01")
        if "\x02, \x02" in cut or "\x02. \x02," in cut or "\x02. \x02." in cut:
            return [_RAW]  # marks in a run are one piece
        return (_RAW + (cut[:-1] + " \x02." if cut[-1] == "." else cut)).split(" ")

    @staticmethod
    def _fine_drop(text: str) -> list[str]:
        if _RAW in text or _MARK in text:
            return [_RAW]
        cut = (text.lower() if text.isascii() else text).replace("\n", " ").replace(", ", " \x02, ").replace(". ", " \x02. ")
        if "\x02, \x02" in cut or "\x02. \x02" in cut:
            return [_RAW]
        return (cut[:-1] + " \x02." if cut[-1:] == "." else cut).split(" ")

    def _fit_fine(self, p: str) -> bool:
        if p in ("\x02,", "\x02.", "\x02\n"):
            return True
        if not self.lead:
            # As the tokenizer sees it: composed and in lower case, which may end in a mark.
            return p == "" or p != _RAW and (p if p.isascii() else unicodedata.normalize("NFC", p).lower())[-1].isalnum()
        p = p.removeprefix(_RAW)
        return p != "" and not p[0].isspace() and p[-1].isalnum()

    @staticmethod
    def _coarse_lead(text: str) -> list[str]:
        return (_RAW + text).split(" ") if _RAW not in text and _MARK not in text else [_RAW]

    @staticmethod
    def _coarse_drop(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").split(" ") if _RAW not in text and _MARK not in text else [_RAW]

    def _fit_coarse(self, p: str) -> bool:
        if not self.lead:
            return p != _RAW
        p = p.removeprefix(_RAW)
        return p != "" and not p[0].isspace() and not p[-1].isspace()

    def _whole(self, text: str) -> bytes:
        """A text with spaces in a row or at its edges, split at the safe places only."""
        first, *rest = _BOUNDARY.split(text)
        found = self.model.encode_batch_fast([first, *(" " + p for p in rest)], add_special_tokens=False)
        return b"".join(array(self.code, e.ids).tobytes() for e in found)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, spaces: str) -> Encoder:
    """One encoder for each file and worker."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of about `most` units; a larger row stands alone."""
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        out.append((at, to))
        at = to
    return out
