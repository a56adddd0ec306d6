"""Reduction of questions, options, subtitle lines and video ids to what they say."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import lru_cache

import regex

# Letters of other scripts that are drawn like Latin ones, and the Latin letter each looks like.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ո": "n", "ս": "u", "օ": "o",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ɡ": "g", "ı": "i", "ɑ": "a", "ℓ": "l",
}

# English number words.
UNITS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * n for n, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
NUMBER_WORDS = frozenset(UNITS) | frozenset(TENS)

#: Words a loader puts before a question; each is a list of words.
LEAD_INS = [x.split() for x in (
    "well", "now", "so", "ok", "okay", "please answer", "please", "question", "based on the video", "watch the clip first", "according to the video", "in the video", "in this video", "answer the question", "answer this", "then", "and", "um", "uh",
)]

UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}--[\t\n\r]]", regex.V1)
TAG = regex.compile(r"</?[a-zA-Z][^<>]*>|\{\\[^{}]*\}")
BREAKS = regex.compile(r"</?(?:br|p|div|li|tr|td)\b[^<>]*>", regex.I)
QUOTE = regex.compile(r"(?<=\p{L})['’‘ʼ`´＇](?=\p{L})")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same for texts of lower-case ASCII.
ASCII_WORD = re.compile("[a-z0-9]+")
ASCII_QUOTE = re.compile("(?<=[A-Za-z])['`](?=[A-Za-z])")
LATIN = regex.compile(r"\p{Latin}")
SPELLED = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}]+")
NUMBERED = regex.compile(r"^\s*[\"“”']*\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|[Qq]\s*\.?\s*\d+\s*[.:)]|\d+\s*[.)])\s*")


def plain(text: str) -> str:
    """Without entities, invisible characters, markup and compatibility forms; case stays."""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    # ASCII without control signs is its own compatibility form.
    if not (text.isascii() and (text.isprintable() or text.replace("\n", "").isprintable())):
        text = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return TAG.sub("", BREAKS.sub(" ", text)) if "<" in text or "{" in text else text


def words_of(text: str) -> list[str]:
    """The words and numbers of a text in order, whatever the case, spacing, punctuation, markup or glyphs."""
    text = plain(text)
    if text.isascii():
        return ASCII_WORD.findall((ASCII_QUOTE.sub("", text) if "'" in text or "`" in text else text).lower())
    text = unicodedata.normalize("NFKC", QUOTE.sub("", text).casefold())
    found = WORD.findall(text)
    if text.isascii():
        return found
    latin = bool(LATIN.search(text))
    return [as_latin(w, latin) for w in found]


def as_latin(word: str, latin_text: bool) -> str:
    if word.isascii() or not latin_text or not any(c in LOOKALIKES for c in word):
        return word
    drawn = "".join(LOOKALIKES.get(c, c) for c in word)
    return drawn if LATIN.search(word) or drawn.isascii() and len(word) > 1 else word


def line_key(text: str | None) -> tuple[str, ...] | None:
    """Words of a line; None for null and blank ones."""
    if text is None or not plain(text).strip():
        return None
    return tuple(words_of(text))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between words, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


#: A word this long may hold slips.
LONG_WORD = 6


@lru_cache(maxsize=200_000)
def same_word(a: str, b: str) -> bool:
    """Equal, or both spelled in letters and one or two slips apart in a longer word."""
    if a == b:
        return True
    short, long = sorted((len(a), len(b)))
    if long < LONG_WORD or short < LONG_WORD - 1 or not SPELLED.fullmatch(a) or not SPELLED.fullmatch(b):
        return False
    return distance(a, b, 2) <= (2 if short >= LONG_WORD else 1)


def frame(words: tuple[str, ...] | list[str]) -> str:
    """What slips leave of a list of words: lists that :func:`same_words` accepts have equal frames."""
    return " ".join(map(frame_word, words))


@lru_cache(maxsize=200_000)
def frame_word(word: str) -> str:
    return "*" if len(word) >= LONG_WORD - 1 and SPELLED.fullmatch(word) else word


def same_words(a: tuple[str, ...] | list[str], b: tuple[str, ...] | list[str]) -> bool:
    return a == b or len(a) == len(b) and all(x == y or same_word(x, y) for x, y in zip(a, b))


def figure(word: str) -> str:
    return str(int(word)) if word.isdecimal() and len(word) < 19 else word


def figures(words: list[str]) -> list[str]:
    """Number words as figures: ``forty two`` becomes ``42``; figures lose leading zeros."""
    if NUMBER_WORDS.isdisjoint(words):
        return [figure(w) if w[0].isdecimal() else w for w in words]
    out, k = [], 0
    while k < len(words):
        w = words[k]
        if w in TENS:
            n = TENS[w]
            if k + 1 < len(words) and 0 < UNITS.get(words[k + 1], 0) < 10:
                n, k = n + UNITS[words[k + 1]], k + 1
            out.append(str(n))
        elif w in UNITS:
            out.append(str(UNITS[w]))
        else:
            out.append(figure(w))
        k += 1
    return out


@lru_cache(maxsize=200_000)
def leads(word: str) -> tuple[list[str], ...]:
    """Lead-ins that may begin with ``word``; all that follow one that was taken away are looked for anew."""
    return tuple(lead for lead in LEAD_INS if same_word(word, lead[0]))


ITEM = regex.compile(r"q\d+")


def asked(question: str) -> list[str]:
    """Words of a question without item numbers, lead-ins and fillers, numbers as figures."""
    text = plain(question)
    words = words_of(NUMBERED.sub("", text))
    changed = True
    while changed:
        changed = False
        for lead in leads(words[0]) if words else ():
            n = len(lead)
            if len(words) > n + 2 and all(same_word(x, y) for x, y in zip(words, lead)):
                words, changed = words[n:], True
        if len(words) > 4 and words[0][0] == "q" and ITEM.fullmatch(words[0]):
            words, changed = words[1:], True
    return figures(words)


QUOTED = regex.compile(r"[\"'“”](.*?)[\"'“”](?=\s*[,\]])", regex.S)
LABEL = regex.compile(r"(?:^|(?<=\s))[(\[]?(\p{L}|\d{1,2})[.):\]](?=\s)")


def choices(options: str) -> list[str]:
    """The single choices of an options text, in any of its notations."""
    text = plain(options).strip()
    if text.startswith("["):
        try:
            got = json.loads(text)
            if isinstance(got, list):
                return [str(x) for x in got]
        except ValueError:
            pass
        return QUOTED.findall(text) or [text]
    if " | " in text or "|" in text:
        return text.split("|")
    marks, want = [], 0
    for m in LABEL.finditer(text):
        mark = m[1].casefold()
        mark = LOOKALIKES.get(mark, mark)
        if mark in (chr(97 + want), str(want + 1)) or want == 0 and mark == "0":
            marks.append(m)
            want += 1
    if marks and not text[: marks[0].start()].strip():
        ends = [m.start() for m in marks[1:]] + [len(text)]
        return [text[m.end() : e] for m, e in zip(marks, ends)]
    return text.split("\n") if "\n" in text else [text]


def choice_set(options: str) -> list[tuple[str, ...]]:
    """The distinct choices as words, sorted."""
    return sorted({tuple(figures(words_of(x))) for x in choices(options)} - {()})


def same_choices(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> bool:
    """Whether two choice sets pair off, each with one that says the same."""
    if a == b:
        return True
    if len(a) != len(b):
        return False
    left = [x for x in b if x not in a]
    for x in a:
        if x in b:
            continue
        hit = next((y for y in left if same_words(x, y)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


VIDEO = regex.compile(r"[vV]?(\d{1,18})(?:\.0)?")
PLAIN_VIDEO = re.compile(r"v[0-9]{9}")
FILE_ENDING = regex.compile(r"\.[A-Za-z][A-Za-z0-9]{1,4}$")
COPY_ENDING = regex.compile(r"[_-](?:burned|raw|sub|subs|subtitled)$", regex.I)


def video_key(text: str | None) -> str | None:
    """One spelling of a video id: ``v`` and nine digits, from a number, a name, a path or a file.

    An id of no known form stays as it is, trimmed and lower-cased.  Null and blank ids give None.
    """
    if text is None:
        return None
    if PLAIN_VIDEO.fullmatch(text):
        return text
    text = plain(text).strip()
    name = text.replace("\\", "/").rpartition("/")[2].strip()
    name = FILE_ENDING.sub("", name)
    name = COPY_ENDING.sub("", name)
    m = VIDEO.fullmatch(name)
    if m:
        return f"v{int(m[1]):09d}"
    return text.casefold() or None
