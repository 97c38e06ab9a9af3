"""One form for text that looks the same when displayed.

Ignorable characters are deleted, blanks of other kinds become plain blanks, full-width forms and joined letters
their plain letters, and accents are composed. Each word is then read as a lattice: every letter stands for the
letters of Latin, Cyrillic and Greek that look like it. The path through the lattice with the fewest changes of
script is kept, among equal ones the one with the best score of the scripts' letter pairs. The result
depends on the lattice only, so words that look alike always come out the same.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable

LATIN, CYRILLIC, GREEK = range(3)

#: Letters that look alike, as Latin, Cyrillic, Greek; a dot where a script has none.
LOOK_ALIKES = """
AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈͿ KКΚ MМΜ N.Ν OОΟ PРΡ SЅ. TТΤ XХΧ YУΥ Z.Ζ QԚ. WԜ. .ГΓ .ПΠ .ФΦ
aаα cсϲ eе. iіι jјϳ oоο pрρ sѕ. xх. yу. hһ. dԁ. qԛ. wԝ. vѵν u.υ .кκ .пπ .фφ
"""
CLASSES = [tuple(None if c == "." else c for c in x) for x in LOOK_ALIKES.split()]
#: The letter that stands for a class: the first that it has.
PROTOTYPE = {c: next(x for x in k if x) for k in CLASSES for c in k if c}
BY_PROTOTYPE = {next(x for x in k if x): k for k in CLASSES}
#: Further letters that look like one of a class: straight U looks like capital Y, palochka like capital I.
PROTOTYPE |= {"\u04ae": "Y", "\u04c0": "I"}

#: Characters without a shape that are not in a category of their own.
IGNORABLE_EXTRA = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u3164\uffa0"


def _plain() -> dict[int, str | None]:
    """Code point -> its plain form, for ignorable characters, blanks, wide and narrow forms and joined letters."""
    out: dict[int, str | None] = {}
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or c in IGNORABLE_EXTRA:
            out[i] = None
        elif kind == "Zs":
            out[i] = " "
        else:
            how = unicodedata.decomposition(c)
            if how.startswith(("<wide>", "<narrow>")):
                out[i] = unicodedata.normalize("NFKC", c)
            elif how.startswith("<compat>") and kind[0] == "L" and len(how.split()) > 2:
                full = unicodedata.normalize("NFKC", c)
                if full.isalpha():
                    out[i] = full
    return out


def script(c: str) -> int | None:
    i = ord(c)
    if 0x370 <= i < 0x400 or 0x1F00 <= i < 0x2000:
        return GREEK
    if 0x400 <= i < 0x530 or 0x1C80 <= i < 0x1C90 or 0x2DE0 <= i < 0x2E00 or 0xA640 <= i < 0xA6A0:
        return CYRILLIC
    if c.isalpha() and i < 0x250 or 0x1E00 <= i < 0x1F00:
        return LATIN
    return None


Model = dict[tuple[int, str, str], float]


#: Score of a letter never seen in a script, of a change of script, and the step down from a pair to a single letter.
FLOOR, BACK_OFF = -12.0, math.log(0.1)


def _pair(model: Model, s: int, a: str, b: str) -> float:
    got = model.get((s, a, b))
    return model.get((s, "", b), FLOOR - BACK_OFF) + BACK_OFF if got is None else got


def best_path(word: str, model: Model) -> str:
    """The letters of a word of prototypes (and marks): fewest script changes first, then the best letter pairs."""
    letters = [(i, c) for i, c in enumerate(word) if not unicodedata.combining(c)]
    # script -> (changes, -score, letters chosen)
    paths: dict[int, tuple[int, float, tuple[str, ...]]] = {}
    for n, (_, c) in enumerate(letters):
        k = BY_PROTOTYPE.get(c)
        options = {s: x for s, x in enumerate(k) if x} if k else {(script(c) if script(c) is not None else LATIN): c}
        new: dict[int, tuple[int, float, tuple[str, ...]]] = {}
        for s, x in options.items():
            if n == 0:
                new[s] = (0, -model.get((s, "", ""), FLOOR) - _pair(model, s, "^", x) if model else float(s), (x,))
                continue
            best = None
            for before, (changes, cost, chosen) in paths.items():
                step = -FLOOR if before != s else -_pair(model, s, chosen[-1], x) if model else 0.0
                got = (changes + (before != s), cost + step, chosen + (x,))
                if best is None or got[:2] < best[:2]:
                    best = got
            new[s] = best
        paths = new
    if not paths:
        return word
    if model:
        paths = {s: (a, b - _pair(model, s, p[-1], "$"), p) for s, (a, b, p) in paths.items()}
    s = min(paths, key=lambda x: (paths[x][0], round(paths[x][1], 9), x))
    out = list(word)
    for (i, _), x in zip(letters, paths[s][2]):
        out[i] = x
    return "".join(out)


def _class(chars: Iterable[str]) -> str:
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


_MARK = "\u0300-\u036f"
_AMBIGUOUS = "".join(sorted(BY_PROTOTYPE))
_LATIN_LETTERS = "A-Za-z\u00c0-\u024f\u1e00-\u1eff"
_OTHER = "\u0370-\u03ff\u0400-\u052f\u1c80-\u1c8f\u1f00-\u1fff"
#: Words with some letter of another script than Latin.
OTHER = re.compile(rf"[{_LATIN_LETTERS}{_MARK}]*[{_OTHER}][{_LATIN_LETTERS}{_OTHER}{_MARK}]*")
#: Words that need the lattice: all letters ambiguous, or some letter of another script than Latin.
NEEDS = re.compile(rf"(?<![{_LATIN_LETTERS}{_OTHER}{_MARK}])(?:[{re.escape(_AMBIGUOUS)}][{_MARK}]*)+(?![{_LATIN_LETTERS}{_OTHER}{_MARK}])|{OTHER.pattern}")


def visual_form(model: Model | None = None, cache_words: int = 200_000) -> Callable[[str], str]:
    """A function from text to its form. Without a model, words of ambiguous letters only are taken as Latin where they can be."""
    plain = _plain()
    look = {ord(c): p for c, p in PROTOTYPE.items() if c != p}
    cache: dict[str, str] = {}
    # without a model an ambiguous word is Latin, as its prototypes are already
    needs = NEEDS if model else OTHER

    def word(m: re.Match) -> str:
        w = m[0]
        got = cache.get(w)
        if got is None:
            if len(cache) >= cache_words:
                cache.clear()
            got = cache[w] = best_path(w, model or {})
        return got

    def form(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFD", text.translate(plain)).translate(look)
        elif not model:
            return text
        text = needs.sub(word, text)
        return text if text.isascii() else unicodedata.normalize("NFC", text)

    return form


def pair_counts(counts: Iterable[tuple[str, int]]) -> dict[tuple[int, str, str], int]:
    """How often each pair of letters comes in the words of each script, from (word, count); ``^`` begins and ``$`` ends a word.

    Words of mixed or uncertain script don't count.
    """
    pairs: dict[tuple[int, str, str], int] = {}
    for word, n in counts:
        scripts = {script(c) for c in word if not unicodedata.combining(c)}
        sure = {script(c) for c in word if c not in PROTOTYPE and not unicodedata.combining(c)}
        if len(scripts) != 1 or scripts != sure or None in scripts:
            continue
        s = scripts.pop()
        padded = ["^", *(c for c in word if not unicodedata.combining(c)), "$"]
        for a, b in zip(padded, padded[1:]):
            pairs[s, a, b] = pairs.get((s, a, b), 0) + n
    return pairs


def pair_scores(counts: Iterable[tuple[str, int]] | dict[tuple[int, str, str], int]) -> Model:
    """Log shares of letter pairs by script, of single letters and of the scripts themselves (with empty letters), from (word, count) or from pair_counts()."""
    pairs = counts if isinstance(counts, dict) else pair_counts(counts)
    firsts: dict[tuple[int, str], float] = {}
    words: dict[int, float] = {}
    singles: dict[tuple[int, str], float] = {}
    for (s, a, b), n in pairs.items():
        firsts[s, a] = firsts.get((s, a), 0) + n
        singles[s, b] = singles.get((s, b), 0) + n
        # a word begins once
        words[s] = words.get(s, 0) + n * (a == "^")
    scores = {(s, a, b): math.log(n / firsts[s, a]) for (s, a, b), n in pairs.items()}
    letters = {s: sum(n for (t, _), n in singles.items() if t == s) for s in words}
    scores |= {(s, "", b): math.log(n / letters[s]) for (s, b), n in singles.items()}
    return scores | {(s, "", ""): math.log(n / sum(words.values())) for s, n in words.items()}
