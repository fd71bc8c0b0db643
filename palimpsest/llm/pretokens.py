"""Splitting of texts before the vocabulary's own steps: white-space words and pattern pieces."""

from __future__ import annotations

import re

import regex

# The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Python's split() also breaks at these, which are not White_Space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NOT_WHITE = re.compile(f"[^{WHITE}]+")


def words(text: str) -> list[str]:
    """The runs without White_Space characters, in order."""
    return _NOT_WHITE.findall(text) if _SEPARATORS.search(text) else text.split()


def lower_words(text: str) -> list[str]:
    """The same for a vocabulary that lower-cases: plain ASCII texts are lower-cased whole, so that fewer words are different."""
    return words(text.lower() if text.isascii() and "<|" not in text else text)


class Splitter:
    """Pieces of a text as a pre-tokenizer pattern finds them.

    Texts of plain Latin characters take an equivalent pattern of the faster standard module:
    there, letters are the word characters without digits and underscore. Others take the
    pattern itself.
    """

    _OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
    # Alternatives that begin with different characters may change places: letters come first.
    _LATIN = re.compile(r" ?[^\W\d_]+| ?\d+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

    def __init__(self, pattern: str):
        # The classes of other engines: \s is White_Space, \S the rest.
        inside = re.sub(r"\[\^\\s", lambda _: f"[^{WHITE}", pattern)
        self._any = regex.compile(inside.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))

    def __call__(self, text: str) -> list[str]:
        return (self._any if self._OTHER.search(text) else self._LATIN).findall(text)


class Recent:
    """A bounded dictionary that keeps what was used last, in two generations of `most` / 2 bytes, about.

    `make` computes the values of all missing keys of a chunk at once.
    """

    #: Bytes of an entry besides the characters of its key: two objects, their slots and a short value.
    ENTRY = 200

    def __init__(self, make, most: int):
        self.make, self.half, self.size, self.new, self.old = make, most // 2, 0, {}, {}

    def hold(self, keys) -> dict:
        """A dictionary that has all of `keys`, until the next call."""
        if self.size > self.half:
            self.size, self.new, self.old = 0, {}, self.new
        new, old = self.new, self.old
        missing = [k for k in keys if k not in new]
        if old:
            again = [k for k in missing if k in old]
            self.add(again, [old[k] for k in again])
            missing = [k for k in missing if k not in old]
        if missing:
            self.add(missing, self.make(missing))
        return new

    def add(self, keys: list, values: list) -> None:
        self.new.update(zip(keys, values, strict=True))
        self.size += self.ENTRY * len(keys) + sum(map(len, keys))


class Each(dict):
    """Key -> value of a cheap function; keeps what was used last, in two generations of `most` / 2 entries."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.half, self.old = function, most // 2, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.function(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict = {}


def kept(key, build):
    """One object a worker process, so that later tasks of the same worker find its dictionaries filled.

    It only saves time: what it holds is a function of the key.
    """
    if key not in _KEPT:
        _KEPT.clear()  # of one operator at a time
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Drop what kept() holds, before a stage that needs the memory and not the dictionaries."""
    _KEPT.clear()


# Byte-level vocabularies show a byte as its own character where that is printable, the others in order from U+0100.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}


class WordPieces:
    """Values of white-space words under a byte-level tokenizers file that lower-cases and drops white space.

    Plain Latin words are cut into the vocabulary's pre-tokens, in lower case, and each of these goes
    to the vocabulary's merges alone, `plain(piece)`: its normalizer and splitter do not change them.
    Words of other characters go to the library whole and together, `value(words)`. `join` puts
    the values of a word's pieces together. Words and pieces share one dictionary of `most` bytes.
    """

    _PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    _WHOLE = re.compile(Splitter._OTHER.pattern + "|\u0130|<[|]")
    _MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())

    def __init__(self, plain, value, join, most: int):
        self.plain, self.value, self.join = plain, value, join
        self.words = Recent(self._values, most)

    def _values(self, new: list[str]) -> list:
        whole, cut, marks, join, plain = self._WHOLE.search, self._PIECES.findall, self._MARKS, self.join, self.plain
        memo = self.words
        held, old = memo.new, memo.old.get
        get = held.get

        def piece(p):
            if (v := get(p)) is None:
                held[p] = v = old(p) or plain(p)
                memo.size += memo.ENTRY + len(p)
            return v

        out, late = [], []
        for w in new:
            core = w.rstrip(marks)
            if core.isalpha() and (core.isascii() or not whole(core)):
                v = piece(core.lower())
                out.append(v if len(core) == len(w) else join((v, piece(w[len(core) :]))))
            elif whole(w):
                late.append(len(out))
                out.append(None)
            else:
                out.append(join(map(piece, cut(w.lower()))))
        for at, v in zip(late, self.value([new[i] for i in late]) if late else (), strict=True):
            out[at] = v
        return out


def word_pieces(vocabulary: str, kind, join, most: int) -> WordPieces:
    """The dictionary for a tokenizers file; `kind` makes a value of a list of ids."""
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(vocabulary)
    merges = tok.model.tokenize

    def plain(p: str):
        return kind([t.id for t in merges(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(SHOWN))])

    return WordPieces(plain, lambda new: [kind(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False)], join, most)
