"""Sentence boundaries across languages and scripts.

Whether a full stop ends a sentence is settled document by document, from its unambiguous places elsewhere: a word that
the document writes with a stop and then a small letter or a sign is an abbreviation there; one it writes with a stop at
the end of a block can end a sentence; a word with a capital inside sentences, and never small, is a name.  What the
document leaves open, the same places of the whole corpus decide, by shares with a confidence bound (:func:`corpus_words`).
Short fixed lists come last and only speak for words that neither knows.  Terminators, quotations and brackets follow the
rules of the script around them.

Null, empty and blank texts have no sentences.  Texts are read whole.  Places are code points from 0, end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import spread, stored

# Abbreviations that stand before a name or a figure, so never end a sentence.
LEADING = frozenset(
    "dr mr mrs ms mx prof st ste sra sres srta hr fr mme mlle mgr rev gen col capt lt sgt hon messrs "
    "no nr nos fig figs abb p pp pág págs pag vol vols ch chap sec eq art cap tab bd ca approx aprox cf vs vgl bzw siehe s n.º nº "
    "z.b d.h u.a c.-à-d i.e e.g viz рис стр см гл табл им ул тов проф ص د م सं डॉ श्री पृ प्रो".split()
)
# Abbreviations that may also end a sentence; a capital after them starts a new one.
TRAILING = frozenset("a.m p.m am pm etc usw al jr sr inc co ltd corp bros u.s u.k д п др m uvm ff bspw".split())
# Words before a German ordinal such as ``am 3. Mai``.
BEFORE_ORDINAL = frozenset("am im vom zum beim der die das den dem des ab bis seit ein eine einen einem einer jeder jeden".split())

MARKS = ".!?…‥。．！？｡؟۔।॥‼⁇⁈⁉"
FULL = set("。．！？｡؟۔।॥‼⁇⁈⁉!?")
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "„": "“”", "‹": "›", "《": "》", '"': '"'}
CLOSERS = "\"'”’»」』）)]】〕›》"
SCAN = regex.compile(rf"(?P<mark>[{MARKS}]+)|(?P<open>[“«「『（(\[【〔„‹《\"])|(?P<thai>(?<=\p{{Thai}})\s+(?=\p{{Thai}}))")
SCAN_PLAIN = re.compile(rf"(?P<mark>[{MARKS}]+)|(?P<open>[“«「『（(\[【〔„‹《\"])")
THAI = re.compile("[฀-๿]")
AFTER = regex.compile(rf"(?:[{regex.escape(CLOSERS, special_only=False)}]|[   ](?=[»”])|\s*</[a-zA-Z][^<>]*>)*")
LEAD = regex.compile(r"(?:\s|<[a-zA-Z][^<>/]*>|[-–—•*#>¿¡\"“„«‘'「『（(\[【]|\p{Cf})*")
BLANK = re.compile(r"(?>\r\n|\n|\r)[^\S\r\n]*(?:(?>\r\n|\n|\r)[^\S\r\n]*)+")
#: The rest of these read backwards from the place where a match must end.
TOKEN = regex.compile(r"(?r)[^\s\"“”„«»‘()（）\[\]<>]+")
SOLID = regex.compile(r"(?r)\S+")
GLUED = regex.compile(r"(?r)(?<![\p{L}\p{N}_./-])\p{L}?\p{Ll}{2,}")
VISIBLE = re.compile(r"\S")
PIECE = re.compile(r"\S+")
DASH = regex.compile(r"\s*[-–—]\s*\p{Lu}")
LETTER = regex.compile(r"\p{L}")
LETTERS = regex.compile(r"\p{L}+")
CASED = regex.compile(r"\p{Lu}|\p{Lt}")
SMALL = regex.compile(r"\p{Ll}")
MARKED = regex.compile(r"\p{M}")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
CASELESS = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Thai}\p{Hebrew}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}&&\p{L}]", regex.V1)
LABEL = regex.compile(r"(?:[-–—•*]\s*)?[(\[]?(?:\p{L}|\d{1,3})[)\]]?$")
NOISE = regex.compile(r"[^\p{L}\p{N}]+")
CAPITAL = regex.compile(r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SMALL_WORD = regex.compile(r"(?<= )\p{Ll}[\p{L}\p{M}]*+")
#: A word that is not the end of something longer and has no stop.
PLAIN = regex.compile(r"(?<![\p{L}\p{N}._-])\p{L}[\p{L}\p{M}-]*+(?!\.)")
#: A full stop alone that touches nothing behind it but closing signs, and where the next thing begins.
STOP = re.compile(rf"(?<![{MARKS}])\.(?![{MARKS}\w])[{re.escape(CLOSERS)}\s]*")
#: Single letters with stops between them.
DOTTED = regex.compile(r"\p{L}{1,2}(?:\.-?\p{L}{1,2})+")

_kinds: dict[str, str] = {}


def kind_of(c: str) -> str:
    """``U`` for a capital, ``l`` for a small letter, ``n`` for a figure, ``o`` for another letter, else a space; by sign."""
    found = _kinds.get(c)
    if found is None:
        found = _kinds[c] = "U" if CASED.match(c) else "l" if SMALL.match(c) else "n" if c.isdigit() else "o" if LETTER.match(c) else " "
    return found


def key(core: str) -> str:
    """Under which a word is counted: any case and composition is one, but a single letter may be an initial, so its case
    counts.  Of a word glued to a sentence before it only the word counts."""
    if not core.isascii():
        core = unicodedata.normalize("NFC", core)
    if "." in core:
        head, _, last = core.rpartition(".")
        if last and len(head) > 2 and head[-3:].isalpha():
            core = last
    return core if len(core) == 1 else core.casefold()


def core_before(block: str, at: int) -> tuple[str, int]:
    """The word that ends at ``at`` without signs in front, and where the token around it begins."""
    m = TOKEN.match(block, 0, at)
    if not m:
        return "", at
    token, begin = m[0], m.start()
    if kind_of(token[0]) == " ":
        lead = NOISE.match(token)
        token = token[lead.end() :] if lead else token
    return token, begin


class Evidence:
    """Places of one text where it is plain whether a word with a stop ends a sentence.

    ``seen`` has, per word: places before a small letter or a sign; before a figure; before a capital or a letter of a
    script without case; at the end of a block.
    """

    def __init__(self) -> None:
        self.seen: dict[str, list[int]] = {}
        self.before: list[tuple[str, str]] = []

    def read(self, block: str, follows: bool = False) -> None:
        """Count a block; with ``follows`` also keep which word with a capital comes after which."""
        if "." not in block:
            return
        cased, n, seen = None, len(block), self.seen
        for m in STOP.finditer(block):
            i, k = m.start(), m.end()
            nxt = block[k] if k < n else ""
            if k == i + 1:
                if nxt and nxt not in ",;:":
                    continue
                where = 0 if nxt else 3
            elif not nxt:
                where = 3
            elif not block[k - 1].isspace() or block[i + 1] in CLOSERS:
                continue
            else:
                kind = kind_of(nxt)
                where = {"U": 2, "l": 0, "n": 1, "o": 2, " ": 4}[kind]
                if where == 4:
                    continue
                if kind == "l":
                    if cased is None:
                        cased = bool(CASED.search(block))
                    if not cased:
                        continue
            core, _ = core_before(block, i)
            if not core or kind_of(core[0]) in " n":
                continue
            word = key(core)
            held = seen.get(word)
            if held is None:
                held = seen[word] = [0, 0, 0, 0]
            held[where] += 1
            if follows and where == 2 and kind == "U":
                self.before.append((word, WORD.match(block, k)[0].casefold()))


def small_forms(text: str, words: set[str]) -> set[str]:
    """Those of ``words`` that the text also writes small, inside a line."""
    if len(words) * len(text) > 2_000_000:
        return words.intersection(SMALL_WORD.findall(text))
    found = set()
    for w in words:
        at = text.find(" " + w)
        while at >= 0:
            after = text[at + 1 + len(w) : at + 2 + len(w)]
            if not after or kind_of(after) in " n" and not MARKED.match(after):
                found.add(w)
                break
            at = text.find(" " + w, at + 1)
    return found


def names_of(text: str) -> set[str]:
    """Words with a capital inside sentences that the text never writes small."""
    names = {m.casefold() for m in CAPITAL.findall(text)}
    return names - small_forms(text, names)


class Judge:
    """What a document, the corpus and the lists know about abbreviations and names, asked in this order.

    ``words`` gives the corpus's class of a word (``leading``, ``trailing``, ``inside`` or ``ordinary``), ``names`` its names.
    ``asked`` counts which source settled the stops.
    """

    def __init__(self, text: str, words: Mapping[str, str], names: frozenset[str] | set[str], lists: bool = True) -> None:
        self.text, self.words, self.corpus_names, self.lists = text, words, names, lists
        self.evidence, self.own_names, self.plain, self.known = Evidence(), None, None, {}
        self.asked: Counter[str] = Counter()

    def listed(self, word: str) -> str:
        word = word.casefold()
        if not self.lists:
            return ""
        if word in TRAILING:
            return "trailing" if DOTTED.fullmatch(word) else "listed"
        return "leading" if word in LEADING or "." in word and word.split(".")[-1] in LEADING else ""

    def kind(self, core: str) -> str:
        """How a word goes on after its stop: empty (an ordinary word), or

        ``leading``: it never ends a sentence; ``inside``: it is an abbreviation that nobody has seen before a capital;
        ``listed``: the same, but a list says that it can end a sentence; ``trailing``: it does both.
        """
        word = key(core)
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self.judged(word)
        self.asked[found[1]] += 1
        return found[0]

    def judged(self, word: str) -> tuple[str, str]:
        if not word or kind_of(word[0]) in " n":
            return "", "form"
        small, _, _, end = self.evidence.seen.get(word, (0, 0, 0, 0))
        corpus = self.words.get(word, "")
        if small and end:
            return "trailing", "document"
        if small:
            if corpus in ("leading", "trailing"):
                return corpus, "document"
            return self.listed(word) or "inside", "document"
        if end:
            return "trailing" if corpus in ("leading", "trailing", "inside") else "", "document"
        if corpus == "ordinary":
            return "", "corpus"
        if corpus:
            return (self.listed(word) or corpus if corpus == "inside" else corpus), "corpus"
        listed = self.listed(word)
        if listed:
            return listed, "list"
        return ("trailing", "form") if DOTTED.fullmatch(word) else ("", "none")

    def name(self, word: str) -> bool:
        """Whether the document, or the corpus where the document does not write the word small, knows a word as a name."""
        word = word.casefold()
        if self.own_names is None:
            self.own_names = names_of(self.text)
        if word in self.own_names:
            return True
        return word in self.corpus_names and not small_forms(self.text, {word})

    def goes_on(self, core: str, follow: str) -> bool:
        """Whether an abbreviation goes on before a word with a capital: that word is a name, so its capital is no sign of
        a start.  A document that also writes the abbreviation as a plain word, without a stop, leaves it open."""
        if not self.name(follow):
            return False
        if self.plain is None:
            self.plain = {w.casefold() for w in PLAIN.findall(self.text)}
        return core.casefold() not in self.plain


def pairs_of(block: str) -> dict[int, int]:
    """Places of the quotations and brackets of a block, opening to closing, in one pass with a stack per sign.

    Nearest pairs first; what has no partner is left out.  A straight quote opens or closes by the white space around it.
    """
    out: dict[int, int] = {}
    for opener, closers in PAIRS.items():
        if opener not in block:
            continue
        if opener == '"':
            ends = [m.start() for m in re.finditer('"', block) if closes(block, m.start())]
            for m in re.finditer('"', block):
                at = bisect_right(ends, m.start())
                if at < len(ends):
                    out[m.start()] = ends[at]
            continue
        held: list[int] = []
        for m in re.finditer("[" + re.escape(opener + closers) + "]", block):
            if m[0] in closers:
                if held:
                    out[held.pop()] = m.start()
            else:
                held.append(m.start())
    return out


def closes(block: str, at: int) -> bool:
    """Whether a straight quote can close."""
    before = block[at - 1] if at else " "
    return before not in "([{<" and not (before.isspace() and at + 1 < len(block) and not block[at + 1].isspace())


def opens(block: str, at: int) -> bool:
    """Whether a straight quote opens; the other signs always do."""
    if block[at] != '"':
        return True
    return (at == 0 or block[at - 1].isspace() or block[at - 1] in ">([{-–—“'") and at + 1 < len(block) and not block[at + 1].isspace()


def following(block: str, at: int) -> str:
    """First sign from ``at`` on that is no white space; empty at the end."""
    m = VISIBLE.search(block, at)
    return m[0] if m else ""


def last_visible(block: str, begin: int, end: int) -> str:
    """Last sign before ``end`` that is no white space."""
    while end > begin and block[end - 1].isspace():
        end -= 1
    return block[end - 1] if end > begin else ""


#: A label such as ``(12)`` with some white space has fewer signs.
LABEL_SIGNS = 24


def is_label(block: str, begin: int, end: int) -> bool:
    return end - begin < LABEL_SIGNS and bool(LABEL.fullmatch(block[begin:end].strip()))


def block_breaks(block: str, judge: Judge) -> list[int]:
    """Places in a block where a sentence ends."""
    small_only = not CASED.search(block)
    breaks: list[int] = []
    start, at, size, tail = 0, 0, len(block), len(block.rstrip())
    lead_of, lead_end = -1, 0
    pairs: dict[int, int] | None = None
    scan = SCAN if THAI.search(block) else SCAN_PLAIN

    def end(place: int) -> None:
        nonlocal start
        if start < place < tail and VISIBLE.search(block, start, place):
            breaks.append(place)
            start = place

    def lead(until: int) -> int:
        """Where the words of the running sentence begin."""
        nonlocal lead_of, lead_end
        if lead_of != start:
            lead_of, lead_end = start, LEAD.match(block, start).end()
        return min(lead_end, until)

    while m := scan.search(block, at):
        at = m.end()
        what = m.lastgroup
        if what == "thai":
            end(m.start())
            continue
        if what == "open":
            here = m.start()
            if not opens(block, here):
                continue
            if pairs is None:
                pairs = pairs_of(block)
            there = pairs.get(here, -1)
            if there < 0:
                continue
            before = start < here and bool(LETTER.search(block, lead(here), here)) and not is_label(block, lead(here), here)
            past = AFTER.match(block, there + 1).end()
            inner = last_visible(block, here + 1, there)
            ended = bool(inner) and inner in MARKS
            nxt = following(block, past)
            if not nxt or past > there + 1 and "</" in block[there:past]:
                goes_on = False
            elif CASELESS.match(nxt) or nxt in ",;:—–،、，；：":
                goes_on = True
            elif nxt.islower():
                goes_on = not (small_only and ended and before and last_visible(block, lead(here), here) in ",:")
            else:
                goes_on = False
            if before or goes_on:
                at = there + 1
                if ended and not goes_on:
                    end(past)
                    at = max(at, past)
            continue
        mark, i, j = m[0], m.start(), at
        if j < tail - 1 and block[j] == " " and kind_of(block[j + 1]) != " ":
            k, first, direct, closed_tag, follow = j, j + 1, False, False, " "
            nxt = block[first]
        else:
            k = AFTER.match(block, j).end()
            at = max(at, k)
            if k >= tail:
                break
            follow = block[j : j + 1]
            direct = k < size and not block[k].isspace()
            first = LEAD.match(block, k).end()
            nxt = block[first : first + 1]
            if direct and nxt and block[k] in ",;:،、，；：)":
                continue
            closed_tag = k > j and "</" in block[j:k]
        kind = kind_of(nxt) if nxt else ""
        full = mark in FULL if len(mark) == 1 else any(c in FULL for c in mark)
        dots = not full and (len(mark) > 1 or mark in "…‥")
        if direct and not closed_tag:
            if full:
                if follow and (CJK.match(follow) or not follow.isascii() or follow.isupper() or follow in "<“\"(（「『«¿¡[-#"):
                    if mark[-1] in "!?" and follow.isascii() and not (follow.isupper() or follow in "<\"([-#"):
                        continue
                    end(k)
            elif dots:
                pass
            elif follow.isupper() and SMALL.match(block[j + 1 : j + 2] or " ") and GLUED.match(block, start, i):
                if judge.kind(core_before(block, i)[0]) != "leading":
                    end(k)
            elif follow == "<" and block[j + 1 : j + 2].isalpha():
                end(k)
            continue
        if full:
            if nxt and nxt in ",;":
                continue
            end(k)
            continue
        if dots:
            if kind == "l" and not closed_tag:
                if small_only and len(list(islice(LETTERS.finditer(block, lead(i), i), 2))) > 1:
                    end(k)
                continue
            end(k)
            continue
        # one full stop
        if closed_tag:
            end(k)
            continue
        if kind in ("", " ") and following(block, k) in "—–,;:" and not DASH.match(block, k):
            continue
        core, begin = core_before(block, i)
        begin = max(begin, start)
        if core and (core.isdigit() or len(core) == 1) and is_label(block, lead(i), i):
            continue
        word = judge.kind(core)
        if len(core) == 1 and kind_of(core) in "Ulo":
            if core.isupper() or kind != "U":
                continue
            if word not in ("trailing", "listed"):
                continue
        if word == "leading":
            continue
        ordinal = False
        if core.isdigit() and len(core) < 3:
            while begin > start and block[begin - 1].isspace():
                begin -= 1
            prior = SOLID.match(block, start, begin)
            ordinal = bool(prior) and prior[0].casefold() in BEFORE_ORDINAL
        if kind == "l":
            if not small_only or ordinal or word in ("inside", "listed"):
                continue
            if word == "trailing" and len(list(islice(PIECE.finditer(block, start, i), 5))) < 5:
                continue
            end(k)
        elif kind == "U":
            if not ordinal and not (word == "inside" and judge.goes_on(core, WORD.match(block, first)[0])):
                end(k)
        elif kind == "n" and word == "inside":
            continue
        else:
            end(k)
    return breaks


def spans(text: str, judge: Judge) -> list[tuple[int, int]]:
    edges = [(m.start(), m.end()) for m in BLANK.finditer(text)] if "\n" in text or "\r" in text else []
    edges.append((len(text), len(text)))
    blocks, at = [], 0
    for stop, after in edges:
        block = text[at:stop]
        if block and not block.isspace():
            blocks.append((at, block))
            judge.evidence.read(block)
        at = after
    out = []
    for at, block in blocks:
        marks = [0, *block_breaks(block, judge), len(block)]
        for a, b in zip(marks, marks[1:]):
            while a < b and block[a].isspace():
                a += 1
            while a < b and block[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((at + a, at + b))
    return out


def sentences(text: str | None, words: Mapping[str, str] | None = None, names: frozenset[str] | set[str] = frozenset(), lists: bool = True) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text; ``words`` and ``names`` are what the corpus knows."""
    if not text or text.isspace():
        return []
    return spans(text, Judge(text, words or {}, names, lists))


COUNTS = "word string, is_name boolean, small long, figure long, capital long, starter long, ended long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to counts of their sure places, combined before the shuffle.

    A capital after a stop is a ``starter`` if its word is small elsewhere in the document.  Such words also vote, a
    vote a document, whether they are names: ``capital`` for and ``small`` against.
    """
    held: dict[tuple[str, bool], list[int]] = {}

    def pack() -> pa.RecordBatch:
        counts = list(zip(*held.values()))
        made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.bool_()), *[pa.array(c, pa.int64()) for c in counts]], names=[c.split()[0] for c in COUNTS.split(", ")])
        held.clear()
        return made

    for b in batches:
        for text in b.column("text").to_pylist():
            if not text or "." not in text:
                continue
            found = Evidence()
            for block in BLANK.split(text) if "\n" in text or "\r" in text else [text]:
                found.read(block, follows=True)
            for word, (small, figure, capital, ended) in found.seen.items():
                row = held.setdefault((word, False), [0, 0, 0, 0, 0])
                row[0] += small
                row[1] += figure
                row[2] += capital
                row[4] += ended
            if found.before:
                after = {w for _, w in found.before}
                also_small = small_forms(text, after)
                for word, follow in found.before:
                    if follow in also_small:
                        row = held[word, False]
                        row[2] -= 1
                        row[3] += 1
                inside = after.intersection(m.casefold() for m in CAPITAL.findall(text))
                for follow in inside | also_small:
                    held.setdefault((follow, True), [0, 0, 0, 0, 0])[0 if follow in also_small else 2] += 1
        if len(held) > 50_000:
            yield pack()
    if held:
        yield pack()


#: Shares below which a word does not end sentences, or from which it surely goes on; deviations of the confidence bound.
RARELY, DEVIATIONS = 0.1, 3.0


def bound(part: Column, whole: Column, sign: int) -> Column:
    """Upper (+1) or lower (-1) confidence bound of a share."""
    z2, n = DEVIATIONS**2, whole.cast("double")
    p = part / n
    return (p + z2 / (2 * n) + sign * DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def corpus_words(documents: DataFrame) -> DataFrame:
    """``word, is_name, kind`` of the words whose behaviour the whole corpus settles.

    ``leading``: ends sentences in less than ``RARELY`` of its places and stands before capitals or figures in more;
    ``inside``: the same, but always before small letters and signs; ``trailing``: does both.  Fixed words of the lists
    that do neither are ``ordinary``; other ordinary words, which are most, need no row.
    """
    counts = spread(documents.select("text")).mapInArrow(count_words, COUNTS).groupBy("word", "is_name").agg(*[F.sum(c).alias(c) for c in ("small", "figure", "capital", "starter", "ended")])
    ends = F.col("starter") + F.col("ended")
    n = F.col("small") + F.col("figure") + F.col("capital") + ends
    never = bound(ends, n, 1) <= RARELY
    kind = (
        F.when(F.col("is_name"), F.when(bound(F.col("capital"), n, -1) >= 0.5, "name"))
        .when(never & (bound(F.col("figure") + F.col("capital"), n, 1) > RARELY), "leading")
        .when(never, "inside")
        .when(bound(F.col("small"), n, -1) >= RARELY, "trailing")
        .when((bound(ends, n, -1) >= RARELY) & F.col("word").isin(sorted(LEADING | TRAILING)), "ordinary")
    )
    return counts.select("word", "is_name", kind.alias("kind")).where("kind is not null")


#: Corpus words that are broadcast (some 40 bytes each); more are joined to the documents that need them.
MOST_BROADCAST = 100_000


def asked_words(text: str | None) -> list[str]:
    """Every word of a text that its judge may look up in the corpus: before a stop, and with a capital after one."""
    out: set[str] = set()
    for block in BLANK.split(text or ""):
        for m in re.finditer(r"\.", block):
            core = core_before(block, m.start())[0]
            if core:
                out.add(key(core))
            follow = WORD.match(block, LEAD.match(block, AFTER.match(block, m.end()).end()).end())
            if follow:
                out.add(follow[0].casefold())
    return sorted(out)


def document_sentences(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, start_pos, end_pos`` (and ``sentence``) of every sentence of every document."""
    schema = "doc_id long, start_pos int, end_pos int" + ", sentence string" * with_text
    names = ["doc_id", "start_pos", "end_pos", *["sentence"] * with_text]
    known = stored(corpus_words(documents))
    some = known.limit(MOST_BROADCAST + 1).toArrow()
    fits = some.num_rows <= MOST_BROADCAST
    columns = some.to_pydict() if fits else {"word": [], "is_name": [], "kind": []}
    sure = [(w, n, k) for w, n, k in zip(columns["word"], columns["is_name"], columns["kind"])]
    shared = documents.sparkSession.sparkContext.broadcast(({w: k for w, n, k in sure if not n}, {w for w, n, _ in sure if n}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            own = b.column("known").to_pylist() if "known" in b.schema.names else [None] * len(ids)
            rows = []
            for d, t, extra in zip(ids, texts, own):
                words, called = shared.value
                if extra:
                    words, called = {x["word"]: x["kind"] for x in extra if not x["is_name"]}, {x["word"] for x in extra if x["is_name"]}
                rows += [(d, s, e, t[s:e]) for s, e in sentences(t, words, called)]
            made = list(zip(*rows)) if rows else [()] * 4
            cols = [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int32()), pa.array(made[2], pa.int32())] + [pa.array(made[3], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=names)

    given = documents.select("doc_id", "text")
    if fits:
        return spread(given).mapInArrow(run, schema)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(d, w) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for w in asked_words(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["doc_id", "word"])

    met = spread(given).mapInArrow(ask, "doc_id long, word string").join(known, "word").groupBy("doc_id").agg(F.collect_set(F.struct("word", "is_name", "kind")).alias("known"))
    joined = given.join(met.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "text", "known").mapInArrow(run, schema)
