"""Which encoding bytes are in: models of byte pairs or of characters, learned from text, and the rules of the multi-byte encodings."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: What is told apart by default: the Unicode forms without a mark, and single-byte pages of Western European text.
ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "cp850", "mac_roman")
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: What a pair that was never seen counts as.
UNSEEN = 0.01
#: The logarithm of how likely a letter, or any other character, is that no learned text held; and as how many characters what is known of single ones counts beside pairs.
NEW_LETTER, NEW_OTHER, BACKED = -24.0, -28.0, 4.0
#: Code points that are told apart; those beyond count as the last one, which is no character.
PLANE = 1 << 16
SENTENCE_ENDS = ".!?:\n"


def pairs(data: bytes) -> np.ndarray:
    """How often each of the 65,536 pairs of neighbouring bytes stands in the data."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return np.bincount(b[:-1] << 8 | b[1:], minlength=1 << 16)


def units(data: bytes) -> np.ndarray:
    """How often each of the 65,536 units of two bytes, from the first on, stands in the data."""
    b = np.frombuffer(data[: len(data) // 2 * 2], np.uint8).astype(np.int64)
    return np.bincount(b[::2] << 8 | b[1::2], minlength=1 << 16)


def possible(data: bytes, encoding: str) -> bool:
    """Whether the data is text of the encoding: sequences of lead and following bytes, surrogates and unused places are as they have to be."""
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


class Models:
    """For each encoding how likely each byte is after the one before it, learned from texts; for those of two-byte units, how likely each unit is."""

    def __init__(self, texts: Iterable[str], encodings: tuple[str, ...] = ENCODINGS):
        self.encodings = encodings
        whole = "\n".join(texts)
        self.wide = np.array([e.startswith("utf-16") for e in encodings])
        rows = []
        for e, wide in zip(encodings, self.wide, strict=True):
            data = whole.encode(e, "ignore")
            n = (units(data) if wide else pairs(data)).reshape(1 if wide else 256, -1) + UNSEEN
            rows.append(np.log(n / n.sum(1, keepdims=True)).ravel())
        self.likelihood = np.stack(rows).astype(np.float32)

    def detect(self, data: bytes) -> tuple[str | None, float]:
        """(encoding, how sure: 0 to 1). A mark decides; else the likeliest of the possible encodings; None if none is possible."""
        for mark, encoding in MARKS:
            if data.startswith(mark):
                return encoding, 1.0
        able = [k for k, e in enumerate(self.encodings) if possible(data, e)]
        if not able:
            return None, 0.0
        if "utf-8" in self.encodings and self.encodings.index("utf-8") in able and not data.isascii():
            return "utf-8", 1.0  # other text hardly ever keeps to the rules of its sequences
        score = self.scores(data, able)
        best = int(score.argmax())
        return self.encodings[able[best]], float(1 / np.exp(np.clip(score - score[best], -700, 0)).sum())

    def scores(self, data: bytes, able: list[int]) -> np.ndarray:
        """The log-likelihood of the data in each of the encodings of these numbers."""
        counts = {wide: (at := np.flatnonzero(n), n[at]) for wide, n in ((True, units(data)), (False, pairs(data)))}
        return np.array([self.likelihood[k][counts[self.wide[k]][0]].astype(np.float64) @ counts[self.wide[k]][1] for k in able])

    def decode(self, data: bytes | None) -> tuple[str | None, str | None, float]:
        """(text without a mark, encoding, how sure)."""
        if data is None:
            return None, None, 0.0
        encoding, sure = self.detect(data)
        return (None if encoding is None else data.decode(encoding, "replace").removeprefix("﻿")), encoding, sure


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), PLANE - 1)


class CharacterModels(Models):
    """Encodings by the text that the bytes would be: how likely each character is after the two before it, whatever their case, and how likely a capital, a small letter, what
    ends a sentence or anything else is after two others; learned from texts.

    What is known of a letter holds in every encoding, and in capitals too, which byte pairs of each encoding see too seldom. Three characters that no text held together count by the last two, and
    two by the last alone.
    """

    def __init__(self, texts: Iterable[str], encodings: tuple[str, ...] = ENCODINGS):
        self.encodings = encodings
        plane = [chr(k) for k in range(PLANE)]
        self.case = np.array([c.isupper() + 2 * c.islower() + 3 * (c in SENTENCE_ENDS) for c in plane], np.int64)
        folded = np.array([ord(x) if len(x := c.lower()) == 1 else k for k, c in enumerate(plane)])
        learned = points("\n".join(texts))
        known, at = np.unique(folded[learned], return_inverse=True)
        number = np.array([not c.isalpha() for c in plane], np.int64)  # what no text held: 0 for letters, 1 for others
        number[known] = np.arange(len(known)) + 2
        self.number, self.n = number[folded], len(known) + 2
        single = np.bincount(at + 2, minlength=self.n) / max(len(at), 1)
        single[:2] = np.exp([NEW_LETTER, NEW_OTHER])
        pairs = np.bincount((at[:-1] + 2) * self.n + at[1:] + 2, minlength=self.n**2).reshape(self.n, self.n)
        pair = (pairs + BACKED * single) / (pairs.sum(1, keepdims=True) + BACKED)
        self.pair = np.log(pair).ravel().astype(np.float32)
        row = at + 2
        threes, n = np.unique((row[:-2] * self.n + row[1:-1]) * self.n + row[2:], return_counts=True)
        twos = np.bincount(threes // self.n, n, self.n**2)
        self.threes = threes
        self.three = np.log(1 + n / (BACKED * pair.ravel()[threes % self.n**2])).astype(np.float32)  # over what the pair gives in the same place
        self.back = np.log(BACKED / (twos + BACKED)).astype(np.float32)
        forms = np.bincount(self.forms(learned), minlength=64).reshape(16, 4) + 1
        self.form = np.log(forms / forms.sum(1, keepdims=True)).ravel()

    def forms(self, code: np.ndarray) -> np.ndarray:
        """A number for the kinds of each three neighbouring characters."""
        case = self.case[code]
        return case[:-2] * 16 + case[1:-1] * 4 + case[2:]

    def scores(self, data: bytes, able: list[int]) -> np.ndarray:
        out = []
        for k in able:
            code = np.concatenate([[10], points(data.decode(self.encodings[k]))]).astype(np.int64)  # as after a line end
            row = self.number[code]
            forms = self.forms(np.concatenate([[10], code]))
            two = row[:-1] * self.n + row[1:]
            three = two[:-1] * self.n + row[2:]
            at = np.minimum(np.searchsorted(self.threes, three), len(self.threes) - 1) if len(self.threes) else np.zeros(0, np.int64)
            held = at[self.threes[at] == three[: len(at)]]
            out.append(self.pair[two].sum(dtype=float) + self.back[two[:-1]].sum(dtype=float) + self.three[held].sum(dtype=float) + self.form[forms].sum())
        return np.array(out)
