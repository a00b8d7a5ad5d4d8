"""Names of people and organisations taken apart by rules: titles, adornments, nicknames, initials, company forms, lines of business, order."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

from .lookalike import back_to_cyrillic, has_native_letters, python_table, python_table_keeping_scripts

# Words that say nothing about who is meant.
TITLES = frozenset("mr mrs ms miss mx dr prof professor eng engr hon rev sir madam mme mlle".split())
COMPANY_FORMS = frozenset("ltd limited inc incorporated corp corporation co company llc plc lp llp gmbh sa".split())
SMALL_WORDS = frozenset("the and of for".split())
_LEAD = re.compile(r"^\s*(?:the\b|attn\b|attention\b|c/o\b|payee\b|pmt\s+to\b|payment\s+to\b|paid\s+to\b|pay\s+to\b|m/s\b|messrs\b|beneficiary\b|ref\b)[\s:.,-]*")
_TAIL_NUMBER = re.compile(r"\s+[-–#]\s*#?\d+\s*$|\s*#\s*\d+\s*$")
_DIGITS = str.maketrans("015", "ols")
_NUMBERS = dict(zip("0123456789", "zero one two three four five six seven eight nine".split()))


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Optimal string alignment: insert, delete, replace, swap of neighbours."""
    if a == b:
        return 0
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
    return row[-1]


def plain(name: str) -> str:
    """Lower-case letters without accents and look-alikes; a name in its own script keeps it."""
    if name.isascii() and name.isprintable():
        return " ".join(name.lower().split())
    text = unicodedata.normalize("NFC", name.translate(python_table_keeping_scripts()))
    if has_native_letters(text):
        if any("Ѐ" <= c <= "ӿ" for c in text):
            text = text.translate(back_to_cyrillic())
    else:
        text = text.translate(python_table())
    text = unicodedata.normalize("NFKD", text.lower())
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


def rewritings(word: str, left_out: int) -> set[str]:
    """The word and what is left of it without one letter, or without up to two."""
    out = {word}
    for _ in range(left_out):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


class Near:
    """Finds the listed words that a word may be an error of, by look-up of rewritings and not word by word.

    Listed words of `shortest` letters or more are found with one error, those of `long` or more with two; the lengths
    differ by one at most.
    """

    def __init__(self, words: Iterable[str], shortest: int = 5, long: int = 10):
        self.shortest, self.long, self.longest, self.by = shortest, long, 0, {}
        for w in words:
            self.longest = max(self.longest, len(w))
            if len(w) >= shortest:
                for f in rewritings(w, 2 if len(w) >= long else 1):
                    self.by.setdefault(f, set()).add(w)

    def __call__(self, word: str) -> dict[str, int]:
        """Listed word to number of errors."""
        if not self.shortest - 1 <= len(word) <= self.longest + 1:
            return {}
        near = {w for f in rewritings(word, 2 if len(word) >= self.long - 1 else 1) for w in self.by.get(f, ())}
        found = {w: distance(word, w) for w in near if abs(len(w) - len(word)) <= 1}
        return {w: d for w, d in found.items() if d <= (2 if len(w) >= self.long else 1)}


_company_form_with_error = Near([w for w in COMPANY_FORMS if len(w) >= 7], 7, 99)


@lru_cache(maxsize=50_000)
def is_company_form(token: str) -> bool:
    return token in COMPANY_FORMS or (len(token) >= 6 and bool(_company_form_with_error(token)))


def _skeleton(word: str) -> str:
    return word[:1] + "".join(c for c in word[1:] if c not in "aeiou")


def _shared(a: str, b: str) -> int:
    """Letters at the beginning that two words share."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def shortens(short: str, word: str) -> bool:
    """Whether a token is a word cut short: its beginning, then consonants of the rest in their order, then perhaps its end."""
    if not 1 < len(short) < len(word) or short[0] != word[0]:
        return False
    lead = _shared(short, word)
    tail = min(_shared(short[::-1], word[::-1]), len(short) - lead)
    rest = iter(word[lead : len(word) - tail])
    return all(c not in "aeiou" and c in rest for c in short[lead : len(short) - tail])


class Lines:
    """Words of lines of business, learned from names (`linewords`), and the tokens that stand for them.

    `words` are those in full, `short` those that names use in short. A token stands for the word that it begins or
    shortens; of several the one it shares most of its beginning with, then most of the end of its consonants, then the
    shortest; what still fits two stands for none.
    """

    def __init__(self, words: Iterable[str] = (), short: Iterable[str] = ()):
        self.words = frozenset(words)
        self.short = {s: w for s in short if s not in self.words and (w := self._full(s))}
        self.near = Near([*self.words, *self.short])
        self.known: dict[tuple[str, bool], str | None] = {}

    def _full(self, token: str) -> str | None:
        fit = [w for w in self.words if shortens(token, w)]
        order = lambda w: (_shared(token, w), _shared(_skeleton(token)[::-1], _skeleton(w)[::-1]), -len(w))
        best = [w for w in fit if order(w) == max(map(order, fit))]
        return best[0] if len(best) == 1 else None

    def word(self, token: str, dotted: bool) -> str | None:
        """The word that a token stands for, typed in full, short or with an error; else None."""
        if len(self.known) > 200_000:
            self.known.clear()
        if (token, dotted) not in self.known:
            self.known[token, dotted] = self._word(token, dotted)
        return self.known[token, dotted]

    def _word(self, token: str, dotted: bool) -> str | None:
        if token in self.words:
            return token
        if token in self.short:
            return self.short[token]
        if dotted and (w := self._full(token)):
            return w
        near = self.near(token)
        best = {self.short.get(w, w) for w, d in near.items() if d == min(near.values())}
        return best.pop() if len(best) == 1 else None

    def beginning(self, word: str) -> list[str]:
        """The one word that begins like this."""
        full = [w for w in self.words if w.startswith(word)]
        return full if len(full) == 1 else []


class Rules:
    """What parsing needs besides the fixed words: nicknames (short to full form) and words of lines of business."""

    def __init__(self, nicknames: dict[str, str], lines: Lines | None = None):
        self.nicknames, self.lines = nicknames, lines or Lines()
        self.full = {**{f: f for f in nicknames.values()}, **nicknames}
        self.near = Near(self.full)

    def given(self, word: str) -> str:
        """A nickname's full form; so for a listed name with one error, if it can be only one."""
        if word in self.nicknames:
            return self.nicknames[word]
        if len(word) < 5:
            return word
        near = {self.full[w] for w, d in self.near(word).items() if d <= 1}
        return near.pop() if len(near) == 1 else word


@dataclass(frozen=True)
class Name:
    """kind P: parts (long words, nicknames in full), initials; kind O: parts (core, one word), lines (of business), letters as typed."""

    kind: str
    parts: tuple[str, ...]
    initials: str = ""
    lines: tuple[str, ...] = ()
    letters: str = ""

    @property
    def key(self) -> str:
        """Equal for all rewritings without errors of one full name."""
        return f"{self.kind}|{' '.join(sorted(self.parts))}|{self.initials}{' '.join(self.lines)}"


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token, followed by a full stop)."""
    out = []
    for m in re.finditer(r"(\w+)(\.?)", text):
        t = m[1].replace("_", "")
        if t and any(c.isalpha() for c in t) and any(c.isdigit() for c in t):
            t = t.translate(_DIGITS)
        if t:
            out.append((_NUMBERS.get(t, t), bool(m[2])))
    return out


def parse(name: str, entity_type: str | None, rules: Rules) -> Name:
    """Takes a name apart. Without an entity type, a company form or a line of business makes it an organisation."""
    text = plain(name)
    text = re.sub(r"['’‘`ʼ]", "", text)
    text = _TAIL_NUMBER.sub("", text)
    for _ in range(3):
        text = _LEAD.sub("", text)
    kind = {"PERSON": "P", "ORGANIZATION": "O"}.get((entity_type or "").strip().upper())
    if kind is None:
        known = rules.lines
        kind = "O" if any(is_company_form(t) or t in known.words or (t in known.short and len(t) > 3) for t, _ in tokens(text)) else "P"
    return _person(text, rules) if kind == "P" else _organisation(text, rules.lines)


def _person(text: str, rules: Rules) -> Name:
    bare = re.sub(r"\([^)]*\)?", " ", text)
    comma = bare.count(",") == 1 and not bare.rstrip().endswith(",")
    if comma:
        last, first = bare.split(",")
        bare = f"{first} {last}"
    read = [t for t, _ in tokens(bare)]
    while len(read) > 1 and read[0] in TITLES:
        read = read[1:]
    if comma:  # a title may stand before the surname, too
        read = [t for t in read if t not in TITLES] or read
    longs = tuple(rules.given(t) for t in read if len(t) > 1)
    initials = "".join(t for t in read if len(t) == 1)
    return Name("P", longs or ("",), initials)


def _organisation(text: str, known: Lines) -> Name:
    def classify(read: list[tuple[str, bool]]) -> tuple[list[str], list[str], bool]:
        core, lines, form = [], [], False
        for t, dotted in read:
            if t in SMALL_WORDS:
                continue
            if is_company_form(t):
                form = True
            elif w := known.word(t, dotted):
                lines.append(w)
            else:
                core.append(t)
        return core, lines, form

    core, lines = [], []
    parts = re.split(r"[()]", text)
    for n, part in enumerate(parts):
        c, w, form = classify(tokens(part))
        if n % 2 and n == len(parts) - 1 and len(c) == 1 and not w:  # a bracket cut short, and perhaps the word in it
            w, c = known.beginning(c[0]), []
        if n % 2 and not w and not form:  # an adornment in brackets
            continue
        core += c
        lines += w
    if not lines and len(core) >= 3 and len(core[-1]) >= 3:  # a last word cut short
        if lines := known.beginning(core[-1]):
            core = core[:-1]
    return Name("O", ("".join(core),), lines=tuple(sorted(set(lines))), letters=re.sub(r"[\W_]", "", text))


def nickname_table(rows: list[tuple[str, str]]) -> dict[str, str]:
    """Short form to full form; a short form of several full ones is kept as it is."""
    out: dict[str, str | None] = {}
    for short, full in rows:
        if short and full:
            s, f = plain(short), plain(full)
            out[s] = f if out.get(s, f) == f else None
    return {s: f for s, f in out.items() if f}
