"""Column functions on answers, tags, tool calls, questions and propositions.  All stay in the JVM."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation
ANSWER_TAG = r"(?is)<\s*answer\s*>(.*?)<\s*/\s*answer\s*>"
# The two boilerplate sentences in front of multiple-choice questions.
BOILERPLATE = (
    "This is a multiple choice question. You must choose the correct answer as a number or letter of the option.",
    "This is a multiple choice question. You must choose the correct answer from the options with the number or letter of the option.",
)
# Words of a specification and the operators they stand for, in the order of replacement.
OPERATORS = (("AND", "&"), ("OR", "|"), ("UNTIL", "U"), ("ALWAYS", "G"), ("EVENTUALLY", "F"), ("NOT", "!"))
SPACE = r"^\s+|\s+$"


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strip(c: Column) -> Column:
    """Without white space at both ends (spaces, tabs and line breaks)."""
    return F.regexp_replace(c, SPACE, "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_of(c: Column, pattern: str, group: int = 1) -> Column:
    """First match or null."""
    return F.try_element_at(found(c, pattern, group), F.lit(1))


def last_of(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(found(c, pattern, group), F.lit(-1))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(c), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def em_check(pred: Column, golds: Column) -> Column:
    """Whether any gold answer equals the prediction after normalisation."""
    return F.coalesce(F.array_contains(F.transform(golds, normalize_answer), normalize_answer(pred)), F.lit(False))


def sub_em_check(pred: Column, golds: Column) -> Column:
    """Whether any normalised gold answer is part of the normalised prediction."""
    mine = normalize_answer(pred)
    return F.coalesce(F.exists(golds, lambda g: mine.contains(normalize_answer(g))), F.lit(False))


def extract_solution(c: Column) -> Column:
    """Content of the last ``<answer>`` block, stripped; null without one."""
    return strip(last_of(c, r"(?s)<answer>(.*?)</answer>"))


def count_answer_tags(c: Column) -> Column:
    return F.struct(F.regexp_count(c, F.lit("<answer>")).alias("opened"), F.regexp_count(c, F.lit("</answer>")).alias("closed"))


def answer_target(c: Column) -> Column:
    """Last answer block in any case and spacing, else the whole text; stripped."""
    return strip(F.coalesce(last_of(c, ANSWER_TAG), c))


DIGITS, LETTERS = r"(\d+)", r"([a-zA-Z]+)"


def parse_answer(c: Column, order: str = "digits_letters", tagged: bool = True) -> Column:
    """First figures or letters of the answer; empty when there are none.

    ``order``: ``digits_letters``, ``letters_digits`` or ``digits``.
    """
    target = answer_target(c) if tagged else c
    parts = {"digits_letters": (DIGITS, LETTERS), "letters_digits": (LETTERS, DIGITS), "digits": (DIGITS,)}[order]
    return F.coalesce(*[first_of(target, p) for p in parts], F.lit(""))


def parse_answer_cot(c: Column) -> Column:
    """Last ``### x``, letters before figures."""
    return F.coalesce(last_of(c, r"### ([a-zA-Z]+)"), last_of(c, r"### (\d+)"), F.lit(""))


def choice_token(token: Column) -> Column:
    """Figures without leading zeros, letters A to F as 0 to 5; otherwise null."""
    t = strip(token)
    return F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, r"^0+(?=\d)", "")).when(t.rlike("^[A-Fa-f]$"), (F.ascii(F.upper(t)) - 65).cast("string"))


CHOICE = r"([A-F]|\d{1,2})"


def announced(keyword: str, link: str = "") -> str:
    """Pattern of a choice behind a keyword in any case, with an optional linking word between."""
    return rf"(?i)\b{keyword}\s*{link}{CHOICE}\b"


# What may announce a choice, in the order of trust, and the word that may link it.
KEYWORDS = {"answer": r"(?:is|:)?\s*", "option": "", "choice": ""}
CHOICE_PATTERNS = (r"\\boxed\{([^{}]+)\}", *[announced(k, link) for k, link in KEYWORDS.items()], rf"^\s*[(\[]?\s*{CHOICE}\s*[)\].,:\-\s]")


def parse_choice_label(c: Column) -> Column:
    """Boxed, announced, leading or bare choice as a number; null if there is none."""
    s = strip(c)
    return F.coalesce(*[choice_token(first_of(s, p)) for p in CHOICE_PATTERNS], choice_token(s))


def parse_mcq(c: Column) -> Column:
    """Figures, else the first single letter A to E, else the first word, else the target itself."""
    target = answer_target(c)
    letters = found(target, LETTERS)
    single = F.try_element_at(F.filter(letters, lambda x: x.rlike("^[A-Ea-e]$")), F.lit(1))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(first_of(target, DIGITS), F.upper(single), F.try_element_at(letters, F.lit(1)), target))


def letter_index(c: Column) -> Column:
    """A to E as 0 to 4, else -1."""
    return F.when(c.rlike("^[A-E]$"), F.ascii(c) - 65).otherwise(F.lit(-1))


def first_char_answer(c: Column) -> Column:
    return F.coalesce(letter_index(F.substring(c, 1, 1)), F.lit(-1))


def char_after_anchor(c: Column, anchor: str) -> Column:
    at = F.instr(c, anchor)
    return F.when(at > 0, letter_index(F.substr(c, at + len(anchor), F.lit(1)))).otherwise(F.lit(-1))


def prediction_index(c: Column) -> Column:
    """``prediction: X`` as 0 to 4; 0 when absent."""
    letter = F.upper(first_of(c, r"(?i)prediction: ([A-E])"))
    return F.when(letter.isNull(), 0).otherwise(letter_index(letter))


def int_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def relevance_list(c: Column) -> Column:
    """Numbers of ``frame relevance: [..]``; empty when absent."""
    return F.coalesce(int_list(first_of(c, r"frame relevance: \[([0-9, ]+)\]")), F.array().cast("array<int>"))


def relevance_scores(c: Column, expected: Column | int) -> Column:
    """Relevance numbers clamped to 1..3, padded with the last (or 3) and cut to ``expected``."""
    n = lit(expected)
    raw = F.transform(int_list(first_of(c, r"(?i)frame relevance:\s*\[([0-9,\s]+)\]")), lambda x: F.greatest(F.lit(1), F.least(F.lit(3), x)))
    given = F.when(F.coalesce(F.size(raw), F.lit(0)) > 0, raw).otherwise(F.array(F.lit(3)))
    return F.slice(F.concat(given, F.array_repeat(F.element_at(given, -1), n)), F.lit(1), n)


def intervals(c: Column) -> Column:
    """``[[a, b], ...]`` of a text such as ``[1, 5] and [None, 7].``; None opens at 0 and closes at 1."""
    head = F.regexp_extract(F.trim(F.split_part(c, F.lit("."), F.lit(1))), r"(?s)^(.*\])", 1)

    def one(part: Column) -> Column:
        clean = lambda x: F.regexp_replace(x, r"^[ \[\]]+|[ \[\]]+$", "")
        ends = F.split(part, ",")
        start, end = clean(ends[0]), clean(F.try_element_at(ends, F.lit(2)))
        bound = lambda x, none: F.when(x == "None", F.lit(none)).otherwise(x.try_cast("int"))
        return F.when(part.contains(","), F.array(bound(start, 0), bound(end, 1))).otherwise(F.array(F.lit(0), F.lit(0)))

    return F.transform(F.split(head, "and"), one)


def choice_to_index(answer: Column, candidates: Column) -> Column:
    """Letter, 0-based or 1-based number, or candidate text as a 0-based number in text; else null."""
    a, n = strip(answer), F.size(candidates)
    letter = F.ascii(F.upper(F.regexp_extract(a, r"^[(\[]?([A-Za-z])[)\]]?$", 1))) - 65
    number = F.when(a.rlike(r"^\d+$"), a.try_cast("int"))
    place = F.array_position(F.transform(candidates, lambda x: F.lower(strip(x))), F.lower(a)) - 1
    by_number = F.when((number >= 0) & (number < n), number).when((number >= 1) & (number <= n), number - 1)
    return F.coalesce(F.when((letter >= 0) & (letter < n), letter), by_number, F.when(place >= 0, place.cast("int"))).cast("string")


def truth_index(answer: Column, candidates: Column) -> Column:
    """0 to 4 from a number, a letter or a candidate's exact text; else -1."""
    a = strip(answer)
    number = F.when(a.rlike(r"^\d+$"), F.when(a.try_cast("int").between(0, 4), a.try_cast("int")).otherwise(-1))
    letter = F.when(F.upper(a).rlike("^[A-E]$"), F.ascii(F.upper(a)) - 65)
    place = F.array_position(F.transform(candidates, strip), a).cast("int") - 1
    return F.coalesce(number, letter, place, F.lit(-1))


def choice_text(candidates: Column, choice: Column) -> Column:
    """Text of the chosen candidate by number or letter; empty when there is none."""
    c = strip(choice)
    at = F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(c.rlike("^[A-Za-z]$"), F.ascii(F.upper(c)) - 65)
    return F.coalesce(F.try_element_at(candidates, at + 1), F.lit(""))


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def parse_response(c: Column, just_thought: bool = False) -> Column:
    """thought, answer, search and subtitle of a tagged response.

    Exactly one of the last three must be given, otherwise null (or all empty with ``just_thought``).
    """
    part = lambda tag, most: shorten(strip(first_of(c, rf"(?s)<{tag}>(.*?)</{tag}>")), most)
    thought, answer, search, subtitle = part("think", 1000), part("answer", 200), part("search", 200), part("search_subtitle", 200)
    given = answer.isNotNull().cast("int") + F.coalesce(search != "", F.lit(False)).cast("int") + F.coalesce(subtitle != "", F.lit(False)).cast("int")
    empty = lambda x: F.nullif(x, F.lit(""))
    full = F.struct(F.coalesce(thought, F.lit("")).alias("thought"), empty(answer).alias("answer"), empty(search).alias("search"), empty(subtitle).alias("subtitle"))
    blank = F.struct(F.coalesce(thought, F.lit("")).alias("thought"), *[F.lit("").alias(x) for x in ("answer", "search", "subtitle")])
    return F.when(given == 1, full).otherwise(blank) if just_thought else F.when(given == 1, full)


TOOL_TAGS = (("search", "base"), ("search_subtitle", "subtitle"), ("search_summary", "summary"))


def tag_tool_calls(c: Column, tags: tuple[str, ...] = ("search", "search_subtitle", "search_summary")) -> Column:
    """All tool calls after the last ``</think>`` as structs (query, mode), tag by tag."""
    after = F.element_at(F.split(c, "</think>"), -1)

    def of(tag: str, mode: str) -> Column:
        call = lambda q: F.struct((F.lit("summary") if mode == "summary" else q).alias("query"), F.lit(mode).alias("mode"))
        return F.transform(found(after, rf"(?s)<{tag}>(.*?)</{tag}>"), call)

    return F.concat(*[of(tag, mode) for tag, mode in TOOL_TAGS if tag in tags])


def first_tag_calls(c: Column) -> Column:
    """First call of each tag on one line, in the whole text."""
    one = lambda tag, mode: F.when(F.rlike(c, F.lit(rf"<{tag}>.*?</{tag}>")), F.struct(first_of(c, rf"<{tag}>(.*?)</{tag}>").alias("query"), F.lit(mode).alias("mode")))
    return F.array_compact(F.array(one("search", "base"), one("search_subtitle", "subtitle")))


def tool_action(c: Column) -> Column:
    """One action by priority: search, subtitle search, summary; last match, non-empty query."""
    last = lambda tag: F.nullif(strip(last_of(c, rf"(?is)<{tag}>(.*?)</{tag}>")), F.lit(""))
    act = lambda name, query: F.struct(F.lit(name).alias("action"), query.alias("query"))
    search, subtitle = last("search"), last("search_subtitle")
    summary = F.rlike(c, F.lit(r"(?i)<search_summary>\s*</search_summary>"))
    return F.when(search.isNotNull(), act("search", search)).when(subtitle.isNotNull(), act("search_subtitle", subtitle)).when(summary, act("search_summary", F.lit("")))


def json_tool_calls(c: Column) -> Column:
    """(name, arguments) of fenced JSON blocks with ``tool_calls``, ``function`` or name and arguments; else of inline calls."""
    call = "struct<name:string,arguments:string,function:struct<name:string,arguments:string>>"
    block = f"struct<type:string,name:string,arguments:string,function:struct<name:string,arguments:string>,tool_calls:array<{call}>>"
    blocks = F.transform(found(c, r"(?i)```json\s*(\{[\s\S]*?\})\s*```"), lambda b: F.from_json(b, block))
    pair = lambda name, arguments: F.struct(name.alias("name"), arguments.alias("arguments"))
    of = lambda x: pair(F.coalesce(x["function"]["name"], x["name"]), F.coalesce(x["function"]["arguments"], x["arguments"], F.lit("{}")))
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    expand = lambda b: F.when(b["tool_calls"].isNotNull(), F.transform(b["tool_calls"], of)).when(F.coalesce(b["function"]["name"], b["name"]).isNotNull(), F.array(of(b))).otherwise(none)
    fenced = F.filter(F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), expand)), lambda x: x["name"].isNotNull())
    inline = r"\{[^{}]*?\"name\"\s*:\s*\"([^\"]+)\"[^{}]*?\"arguments\"\s*:\s*(\{[^{}]*?\})[^{}]*?\}"
    bare = F.zip_with(found(c, inline, 1), found(c, inline, 2), pair)
    return F.when(F.size(fenced) > 0, fenced).otherwise(bare)


def function_calls(c: Column) -> Column:
    """``<tool_call>f(k=v, ...)</tool_call>`` as structs (name, arguments map); a repeated key keeps its last value."""

    def one(body: Column) -> Column:
        pairs = F.filter(F.split(F.regexp_extract(body, r"(?s)^\s*\w+\((.*?)\)", 1), ","), lambda x: x.contains("="))
        key = lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1)))
        value = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.substr(x, F.instr(x, "=") + 1)), '^"+|"+$', ""), "^'+|'+$", "")
        fold = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != key(x)), F.create_map(key(x), value(x))))
        return F.struct(F.regexp_extract(body, r"^\s*(\w+)\(", 1).alias("name"), fold.alias("arguments"))

    return F.transform(F.filter(found(c, r"(?s)<tool_call>(.*?)</tool_call>"), lambda x: F.rlike(x, F.lit(r"(?s)^\s*\w+\(.*?\)"))), one)


GRAMMAR_TAGS = ("<think>", "</think>", "<tool_call>", "</tool_call>", "<answer>", "</answer>")
GRAMMAR = "^\\s*\x01[^\x01-\x06]*\x02\\s*(\x03[^\x01-\x06]*\x04\\s*)*\x05[^\x01-\x06]*\x06\\s*$"


def is_valid_sequence(c: Column) -> Column:
    """Whether the assistant's part is one thought, any tool calls and one answer, with only white space between."""
    marker = "<|im_start|>assistant"
    content = F.substr(c, F.instr(c, marker) + len(marker))
    for k, tag in enumerate(GRAMMAR_TAGS, 1):
        content = F.replace(content, F.lit(tag), F.lit(chr(k)))
    return F.coalesce((F.instr(c, marker) > 0) & F.rlike(content, F.lit(GRAMMAR)), F.lit(False))


def sequence_reason(c: Column) -> Column:
    """Why a sequence is not valid: first failed check, or ``valid``."""
    marker = "<|im_start|>assistant"
    content = F.substr(c, F.instr(c, marker) + len(marker))
    checks = F.when(F.instr(c, marker) == 0, "missing assistant marker")
    for tag in ("think", "tool_call", "answer"):
        checks = checks.when(F.regexp_count(content, F.lit(f"<{tag}>")) != F.regexp_count(content, F.lit(f"</{tag}>")), f"mismatch in {tag} tags")
    return checks.when(~is_valid_sequence(c), "unexpected order or content").otherwise("valid")


def sanitize_output(c: Column, tags: tuple[str, ...] = ("search", "search_subtitle", "answer")) -> Column:
    """The thought and the first of ``tags`` that occurs, rebuilt."""
    think = F.concat(F.lit("<think>"), F.coalesce(first_of(c, r"(?s)<think>(.*?)</think>"), F.lit("")), F.lit("</think>"))
    rest = F.coalesce(*[F.concat(F.lit(f"<{t}>"), strip(first_of(c, rf"(?s)<{t}>(.*?)</{t}>")), F.lit(f"</{t}>")) for t in tags], F.lit(""))
    return F.concat(think, rest)


def thoughts(messages: Column) -> Column:
    """All non-empty thoughts of the assistant's messages (structs role, content)."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.filter(F.flatten(F.transform(own, lambda m: F.transform(found(m["content"], r"(?s)<think>(.*?)</think>"), strip))), lambda t: t != "")


def truncate_text(c: Column, most: int, side: str = "left") -> Column:
    """Tool text cut to ``most`` characters: keep the start (``left``), the end (``right``) or both ends."""
    half = most // 2
    cut = {
        "left": F.concat(F.substring(c, 1, most), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(c, F.lit(most))),
    }.get(side, F.concat(F.substring(c, 1, half), F.lit("...(truncated)..."), F.right(c, F.lit(half))))
    return F.when(F.length(c) > most, cut).otherwise(c)


def after_question(c: Column) -> Column:
    """Text after the last ``Question:``."""
    return strip(F.element_at(F.split(c, "Question:"), -1))


def bare_question(c: Column) -> Column:
    """Without boilerplate and a leading ``Question:``."""
    for text in BOILERPLATE:
        c = F.replace(c, F.lit(text), F.lit(""))
    return strip(F.regexp_replace(c, r"(?i)^\s*Question:\s*", ""))


def question_key(c: Column) -> Column:
    """White space collapsed, lower case: the key questions are compared by."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    """Proposition as an identifier."""
    c = F.regexp_replace(c, "^[^a-zA-Z]+|[^a-zA-Z]+$", "")
    c = F.lower(F.translate(F.regexp_replace(c, r"\s+", "_"), "-'", "_"))
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlap; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(F.lit(0))


def rewrite_specification(specification: Column, propositions: Column, word_boundary: bool = False) -> Column:
    """Propositions (longest first, if they occur once) as quoted slugs, then operator words as signs.

    Operator words are replaced anywhere in the text unless ``word_boundary`` is set.
    """
    by_length = F.array_sort(propositions, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    spec = F.aggregate(by_length, specification, lambda s, p: F.when(occurrences(s, p) == 1, F.replace(s, p, F.concat(F.lit('"'), slug(p), F.lit('"')))).otherwise(s))
    for word, sign in OPERATORS:
        spec = F.regexp_replace(spec, rf"\b{word}\b", sign) if word_boundary else F.replace(spec, F.lit(word), F.lit(sign))
    return spec


def and_specification(propositions: Column) -> Column:
    return F.array_join(F.transform(propositions, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), " & ")


def clean_primitives(values: Column) -> Column:
    """White space collapsed, quotes stripped, empty ones dropped, first of equal ones (in any case) kept."""
    clean = F.filter(F.transform(values, lambda v: F.regexp_replace(strip(F.regexp_replace(v, r"\s+", " ")), '^"+|"+$', "")), lambda v: v != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def fragment(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def remove_blocks(c: Column, tags: tuple[str, ...] = ("think", "search", "search_subtitle", "search_summary")) -> Column:
    """Text without the blocks of ``tags``: the final answer of a free response."""
    return strip(reduce(lambda s, t: F.regexp_replace(s, rf"(?s)<{t}>.*?</{t}>", ""), tags, c))


def thinking(c: Column) -> Column:
    return F.coalesce(strip(first_of(c, r"(?s)<think>(.*?)</think>")), F.lit(""))


def data_url(c: Column) -> Column:
    """Bytes of a base64 data URL; null for other text."""
    head = r"(?s)^data:[^;,]*;base64,(.*)$"
    return F.when(F.rlike(c, F.lit(head)), F.try_to_binary(F.regexp_extract(c, head, 1), F.lit("base64")))


def json_object(c: Column) -> Column:
    """The part from the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def option_list(c: Column) -> Column:
    """The single options of one text: a JSON list, or parts between bars, or lines without their letters or numbers."""
    bare = lambda x: F.regexp_replace(x, r"^[ \t]*[(\[]?(?:[A-Za-z]|[0-9]{1,2})[.):\]][ \t]+", "")
    lines = F.transform(F.filter(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t]")), bare)
    listed = F.when(c.startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(listed, F.when(c.contains(" | "), F.split(c, r" \| ")).otherwise(lines))


def option_lines(candidates: Column, style: str = "paren") -> Column:
    """Numbered options, one a line: ``paren`` 0) x, ``plain`` 0 x, ``dot`` 0. x, ``bare`` x."""
    sign = {"paren": ") ", "plain": " ", "dot": ". "}.get(style)
    lines = candidates if sign is None else F.transform(candidates, lambda x, i: F.concat(i.cast("string"), F.lit(sign), x))
    return F.array_join(lines, "\n")


#: Option style of each dataset in prompts and in evaluation.
PROMPT_STYLE = {"lvb": "paren", "cgbench": "paren", "mlvu": "plain", "lvbench": "bare", "videomme": "bare"}
EVAL_STYLE = {"lvbench": "bare", "videomme": "bare"}


def prompt_text(question: Column, candidates: Column, dataset: str) -> Column:
    head = F.concat(F.lit("Question: "), strip(question)) if dataset == "videomme" else strip(question)
    return F.concat(head, F.lit("\n"), option_lines(candidates, PROMPT_STYLE.get(dataset, "paren")))


def message_text(content: Column) -> Column:
    """Text parts of a message's content (structs type, text) joined by line breaks."""
    return strip(F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))


def message_images(content: Column) -> Column:
    return F.size(F.filter(content, lambda p: p["type"] == "image_url"))
