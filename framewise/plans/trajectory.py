"""Queries that parse answers, tags, tool calls and turns of the texts in ``documents`` and ``data_input``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.functions import text as T
from framewise.operators import trajectory
from framewise.plans.views import query, table

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
TARGET = STRIP.format(x="coalesce(list_extract(regexp_extract_all(text, '(?is)<\\s*answer\\s*>(.*?)<\\s*/\\s*answer\\s*>', 1), -1), text)")
DG = "list_extract(regexp_extract_all(t, '(\\d+)', 1), 1)"
LT = "list_extract(regexp_extract_all(t, '([a-zA-Z]+)', 1), 1)"


def first(tag: str, x: str = "text") -> str:
    return f"list_extract(regexp_extract_all({x}, '(?s)<{tag}>(.*?)</{tag}>', 1), 1)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "kind", "text")


@query(f"""WITH d AS (SELECT doc_id, text, {TARGET} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce({DG}, {LT}, '') AS digits_first, coalesce({LT}, {DG}, '') AS letters_first, coalesce({DG}, '') AS digits,
coalesce(list_extract(regexp_extract_all(text, '### ([a-zA-Z]+)', 1), -1), list_extract(regexp_extract_all(text, '### (\\d+)', 1), -1), '') AS cot,
CASE WHEN text = '' THEN '' ELSE coalesce({DG}, upper(list_extract(list_filter(regexp_extract_all(t, '([a-zA-Z]+)', 1), lambda x: regexp_full_match(x, '[A-Ea-e]')), 1)), {LT}, t) END AS mcq FROM d""")
def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer parsers side by side."""
    c = F.col("text")
    return docs(spark, d).select("doc_id", T.parse_answer(c).alias("digits_first"), T.parse_answer(c, "letters_digits").alias("letters_first"), T.parse_answer(c, "digits").alias("digits"), T.parse_answer_cot(c).alias("cot"), T.parse_mcq(c).alias("mcq"))


CASES = "concat_ws('', CASE doc_id % 7 WHEN 0 THEN 'So \\boxed{' || (doc_id % 12) || '}' WHEN 1 THEN 'Answer: ' || chr((65 + doc_id % 7)::INT) || ' because' WHEN 2 THEN 'I take option ' || (doc_id % 9) WHEN 3 THEN '(' || chr((65 + doc_id % 6)::INT) || ') is right' WHEN 4 THEN ' 0' || (doc_id % 10) || ' ' WHEN 5 THEN 'choice b' ELSE 'unclear' END)"
TOKEN = "CASE WHEN regexp_full_match({t}, '\\d+') THEN CAST(CAST({t} AS INT) AS VARCHAR) WHEN regexp_full_match({t}, '[A-Fa-f]') THEN CAST(ascii(upper({t})) - 65 AS VARCHAR) END"
LABELS = "coalesce(" + ", ".join(TOKEN.format(t=STRIP.format(x=f"list_extract(regexp_extract_all(s, '{p}', 1), 1)")) for p in T.CHOICE_PATTERNS) + ", " + TOKEN.format(t="s") + ")"


@query(f"WITH c AS (SELECT doc_id, {STRIP.format(x=CASES)} AS s FROM documents) SELECT doc_id, {LABELS} AS label FROM c")
def choice_labels(spark: SparkSession, d: str) -> DataFrame:
    """F8: boxed, announced, leading and bare choices."""
    n = F.col("doc_id")
    m = lambda k: (n % k).cast("string")
    case = F.when(n % 7 == 0, F.concat(F.lit("So \\boxed{"), m(12), F.lit("}"))).when(n % 7 == 1, F.concat(F.lit("Answer: "), F.char(65 + n % 7), F.lit(" because"))).when(n % 7 == 2, F.concat(F.lit("I take option "), m(9)))
    case = case.when(n % 7 == 3, F.concat(F.lit("("), F.char(65 + n % 6), F.lit(") is right"))).when(n % 7 == 4, F.concat(F.lit(" 0"), m(10), F.lit(" "))).when(n % 7 == 5, "choice b").otherwise("unclear")
    return table(spark, d, "documents").select("doc_id", T.parse_choice_label(case).alias("label"))


SHORT = "CASE WHEN length({x}) > {n} THEN substr({x}, 1, {m}) || '...' ELSE {x} END"
FIELD = lambda tag, n: SHORT.format(x=STRIP.format(x=first(tag)), n=n, m=n - 3)


@query(f"""WITH f AS (SELECT doc_id, {FIELD('think', 1000)} AS th, {FIELD('answer', 200)} AS a, {FIELD('search', 200)} AS s, {FIELD('search_subtitle', 200)} AS u FROM documents WHERE text IS NOT NULL)
SELECT doc_id, coalesce(th, '') AS thought, nullif(a, '') AS answer, nullif(s, '') AS search, nullif(u, '') AS subtitle FROM f WHERE (a IS NOT NULL)::INT + coalesce(s <> '', false)::INT + coalesce(u <> '', false)::INT = 1""")
def response_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a response, with exactly one of answer, search and subtitle."""
    return docs(spark, d).select("doc_id", T.parse_response(F.col("text")).alias("r")).where("r is not null").select("doc_id", "r.*")


@query("""WITH a AS (SELECT doc_id, list_extract(string_split(text, '</think>'), -1) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'base' AS mode, unnest(regexp_extract_all(t, '(?s)<search>(.*?)</search>', 1)) AS query FROM a UNION ALL
SELECT doc_id, 'subtitle', unnest(regexp_extract_all(t, '(?s)<search_subtitle>(.*?)</search_subtitle>', 1)) FROM a UNION ALL
SELECT doc_id, 'summary', unnest(list_transform(regexp_extract_all(t, '(?s)<search_summary>(.*?)</search_summary>', 1), lambda x: 'summary')) FROM a""")
def tag_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls after the last thought."""
    return docs(spark, d).select("doc_id", F.explode(T.tag_tool_calls(F.col("text"))).alias("c")).select("doc_id", "c.mode", "c.query")


LAST = lambda tag: "nullif(" + STRIP.format(x=f"list_extract(regexp_extract_all(text, '(?is)<{tag}>(.*?)</{tag}>', 1), -1)") + ", '')"


@query(f"""WITH a AS (SELECT doc_id, {LAST('search')} AS s, {LAST('search_subtitle')} AS u, regexp_matches(text, '(?i)<search_summary>\\s*</search_summary>') AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN s IS NOT NULL THEN 'search' WHEN u IS NOT NULL THEN 'search_subtitle' ELSE 'search_summary' END AS action, CASE WHEN s IS NOT NULL THEN s WHEN u IS NOT NULL THEN u ELSE '' END AS query FROM a WHERE s IS NOT NULL OR u IS NOT NULL OR m""")
def tool_actions(spark: SparkSession, d: str) -> DataFrame:
    """one action by priority."""
    return docs(spark, d).select("doc_id", T.tool_action(F.col("text")).alias("a")).where("a is not null").select("doc_id", "a.*")


@query("""SELECT doc_id, 'base' AS mode, list_extract(regexp_extract_all(text, '<search>(.*?)</search>', 1), 1) AS query FROM documents WHERE regexp_matches(text, '<search>.*?</search>') UNION ALL
SELECT doc_id, 'subtitle', list_extract(regexp_extract_all(text, '<search_subtitle>(.*?)</search_subtitle>', 1), 1) FROM documents WHERE regexp_matches(text, '<search_subtitle>.*?</search_subtitle>')""")
def first_tag_calls(spark: SparkSession, d: str) -> DataFrame:
    """first one-line call of each tag."""
    line = F.translate("text", "\r", " ")  # a dot stops at carriage returns in Java only
    return docs(spark, d).select("doc_id", F.explode(T.first_tag_calls(line)).alias("c")).select("doc_id", "c.mode", F.col("c.query").alias("query"))


@query("""SELECT entry_id, 'search' AS name, 'topk=' || entry_id % 5 || ';video=' || data_source AS arguments FROM data_input UNION ALL SELECT entry_id, 'stop', '' FROM data_input WHERE entry_id % 3 = 0""")
def function_calls(spark: SparkSession, d: str) -> DataFrame:
    """calls written as f(k=v, ...), a repeated key keeping its last value."""
    n = F.col("entry_id")
    raw = F.concat(F.lit("<tool_call> search(topk=9, video=\""), "data_source", F.lit("\", topk="), (n % 5).cast("string"), F.lit(")</tool_call>"), F.when(n % 3 == 0, "<tool_call>stop()</tool_call>").otherwise(""))
    calls = table(spark, d, "data_input").select("entry_id", F.explode(T.function_calls(raw)).alias("c"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("c.arguments")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return calls.select("entry_id", "c.name", pairs.alias("arguments"))


@query("SELECT entry_id, 'video_search' AS name, '{\"query\":\"q' || entry_id % 9 || '\",\"mode\":\"base\"}' AS arguments FROM data_input")
def json_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """F16: calls in fenced or inline JSON, in three notations."""
    args = F.concat(F.lit('{"query":"q'), (F.col("entry_id") % 9).cast("string"), F.lit('","mode":"base"}'))
    call = F.concat(F.lit('{"name":"video_search","arguments":'), args, F.lit("}"))
    fence = lambda c: F.concat(F.lit("text ```json\n"), c, F.lit("\n``` more"))
    k = F.col("entry_id") % 4
    raw = F.when(k == 0, fence(call)).when(k == 1, fence(F.concat(F.lit('{"tool_calls":[{"function":'), call, F.lit("}]}")))).when(k == 2, fence(F.concat(F.lit('{"type":"function","function":'), call, F.lit("}")))).otherwise(F.concat(F.lit("call "), call, F.lit(" now")))
    return table(spark, d, "data_input").select("entry_id", F.explode(T.json_tool_calls(raw)).alias("c")).select("entry_id", "c.name", "c.arguments")


SEQ = "'x<|im_start|>assistant ' || CASE WHEN doc_id % 5 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '</(search|search_summary|search_subtitle)>\\s*<think>(?:[^<]*)</think>', '</tool_call>', 'g'), '<(/?)(search|search_summary|search_subtitle)>', '<\\1tool_call>', 'g') END"
CONTENT = "".join("replace(" for _ in range(6)) + f"substr(s, instr(s, '<|im_start|>assistant') + 21)" + "".join(f", '{t}', chr({k}))" for k, t in enumerate(T.GRAMMAR_TAGS, 1))


@query(f"""WITH q AS (SELECT doc_id, {SEQ} AS s FROM documents WHERE text IS NOT NULL AND kind = 'reasoning'), c AS (SELECT doc_id, s, {CONTENT} AS c FROM q)
SELECT doc_id, regexp_matches(c, '^\\s*\\x01[^\\x01-\\x06]*\\x02\\s*(\\x03[^\\x01-\\x06]*\\x04\\s*)*\\x05[^\\x01-\\x06]*\\x06\\s*$') AS valid FROM c""")
def valid_sequences(spark: SparkSession, d: str) -> DataFrame:
    """grammar of a trajectory."""
    calls = F.regexp_replace(F.regexp_replace("text", r"</(search|search_summary|search_subtitle)>\s*<think>(?:[^<]*)</think>", "</tool_call>"), "<(/?)(search|search_summary|search_subtitle)>", "<$1tool_call>")
    s = F.concat(F.lit("x<|im_start|>assistant "), F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(calls))
    return docs(spark, d).where("kind = 'reasoning'").select("doc_id", T.is_valid_sequence(s).alias("valid"))


@query(f"""SELECT doc_id, '<think>' || coalesce({first('think')}, '') || '</think>' || coalesce('<search>' || {STRIP.format(x=first('search'))} || '</search>', '<search_subtitle>' || {STRIP.format(x=first('search_subtitle'))} || '</search_subtitle>', '<answer>' || {STRIP.format(x=first('answer'))} || '</answer>', '') AS rebuilt FROM documents WHERE text IS NOT NULL""")
def sanitized_outputs(spark: SparkSession, d: str) -> DataFrame:
    """thought and first tag, rebuilt."""
    return docs(spark, d).select("doc_id", T.sanitize_output(F.col("text")).alias("rebuilt"))


@query("""WITH m AS (SELECT video_id, doc_id, CASE WHEN kind = 'reasoning' THEN 'assistant' ELSE 'user' END AS role, text FROM documents WHERE text IS NOT NULL AND video_id IS NOT NULL),
t AS (SELECT video_id, unnest(regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1)) AS th FROM m WHERE role = 'assistant')
SELECT video_id, count(*) AS thoughts, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT video_id, """ + STRIP.format(x="th") + """ AS x FROM t) WHERE x <> '' GROUP BY 1""")
def assistant_thoughts(spark: SparkSession, d: str) -> DataFrame:
    """non-empty thoughts of the assistant's messages."""
    role = F.when(F.col("kind") == "reasoning", "assistant").otherwise("user")
    m = table(spark, d, "documents").where("text is not null and video_id is not null").select("video_id", F.array(F.struct(role.alias("role"), F.col("text").alias("content"))).alias("messages"))
    return m.select("video_id", F.explode(T.thoughts(F.col("messages"))).alias("t")).groupBy("video_id").agg(F.count("*").alias("thoughts"), F.sum(F.length("t")).alias("chars"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...(truncated)' ELSE text END AS kept_start, CASE WHEN length(text) > 100 THEN '(truncated)...' || right(text, 100) ELSE text END AS kept_end,
CASE WHEN length(text) > 100 THEN left(text, 50) || '...(truncated)...' || right(text, 50) ELSE text END AS kept_both FROM documents WHERE text IS NOT NULL""")
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """tool text cut at either side or in the middle."""
    c = F.col("text")
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", T.truncate_text(c, 100).alias("kept_start"), T.truncate_text(c, 100, "right").alias("kept_end"), T.truncate_text(c, 100, "middle").alias("kept_both"))


BP = "replace(replace(q, 'This is a multiple choice question. You must choose the correct answer as a number or letter of the option.', ''), 'This is a multiple choice question. You must choose the correct answer from the options with the number or letter of the option.', '')"


@query(f"""WITH s AS (SELECT entry_id, 'Intro. Question: ' || question AS q FROM data_input WHERE question IS NOT NULL)
SELECT entry_id, {STRIP.format(x="list_extract(string_split(q, 'Question:'), -1)")} AS after_mark, {STRIP.format(x="regexp_replace(" + BP.replace('q,', "substr(q, 8),", 1) + ", '(?i)^\\s*Question:\\s*', '')")} AS bare, lower({STRIP.format(x="regexp_replace(q, '\\s+', ' ', 'g')")}) AS key FROM s""")
def question_keys(spark: SparkSession, d: str) -> DataFrame:
    """question cleaners."""
    rows = table(spark, d, "data_input").where("question is not null").select("entry_id", F.concat(F.lit("Intro. Question: "), "question").alias("q"))
    return rows.select("entry_id", T.after_question(F.col("q")).alias("after_mark"), T.bare_question(F.substr(F.col("q"), F.lit(8))).alias("bare"), T.question_key(F.col("q")).alias("key"))


SLUG = "regexp_replace(lower(translate(regexp_replace(regexp_replace({x}, '^[^a-zA-Z]+|[^a-zA-Z]+$', '', 'g'), '\\s+', '_', 'g'), '-''', '_')), '[^a-zA-Z0-9_]', '', 'g')"


@query(f"SELECT entry_id, {SLUG.format(x='question')} AS slug, regexp_replace(lower(question), '[^a-z0-9]+', '', 'g') AS fragment FROM data_input")
def proposition_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of propositions and file fragments."""
    return table(spark, d, "data_input").select("entry_id", T.slug(F.col("question")).alias("slug"), T.fragment(F.col("question")).alias("fragment"))


@query("""SELECT p_partkey AS id, '("red_' || lower(p_type) || '" & ! "' || lower(p_type) || '") U "a_' || regexp_replace(lower(p_brand), '[^a-z]', '', 'g') || '" | G "x"' AS spec, '"red ' || p_type || '" & "' || p_type || '"' AS joined FROM part""")
def specifications(spark: SparkSession, d: str) -> DataFrame:
    """Propositions and operator words of a specification rewritten."""
    kind, brand = F.lower("p_type"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""))
    both = F.array(F.concat(F.lit("red  "), kind, F.lit("!")), F.concat(F.lit("<"), kind, F.lit(">")), F.concat(F.lit("a "), brand), F.lit("x."))
    spec = F.concat(F.lit("("), both[0], F.lit(" AND NOT "), both[1], F.lit(") UNTIL "), both[2], F.lit(" OR ALWAYS "), both[3])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.rewrite_specification(spec, both).alias("spec"), T.and_specification(F.array(F.concat(F.lit("red "), "p_type"), F.col("p_type"))).alias("joined"))


@query("SELECT p_partkey AS id, p_type || ' one|two' AS kept FROM part")
def primitives(spark: SparkSession, d: str) -> DataFrame:
    """cleaned propositions, the first of equal ones kept."""
    raw = F.array(F.concat(F.lit('  "'), "p_type", F.lit('  one"')), F.lit(" "), F.concat(F.lower("p_type"), F.lit(" ONE")), F.lit("two"), F.lit('"TWO"'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.clean_primitives(raw), "|").alias("kept"))


FREE = "text"
for _t in ("think", "search", "search_subtitle", "search_summary"):
    FREE = f"regexp_replace({FREE}, '(?s)<{_t}>.*?</{_t}>', '', 'g')"


@query(f"SELECT doc_id, {STRIP.format(x=FREE)} AS answer, coalesce({STRIP.format(x=first('think'))}, '') AS thinking FROM documents WHERE text IS NOT NULL AND kind = 'reasoning'")
def free_answers(spark: SparkSession, d: str) -> DataFrame:
    """final text and first thought of a free response."""
    return docs(spark, d).where("kind = 'reasoning'").select("doc_id", T.remove_blocks(F.col("text")).alias("answer"), T.thinking(F.col("text")).alias("thinking"))


OPTIONS = r"""o AS (SELECT entry_id, question, coalesce(CASE WHEN starts_with(options, '[') THEN TRY_CAST(TRY_CAST(options AS JSON) AS VARCHAR[]) END,
 CASE WHEN contains(options, ' | ') THEN string_split(options, ' | ') ELSE list_transform(list_filter(string_split(replace(options, chr(13), ''), chr(10)), lambda x: regexp_matches(x, '[^ \t]')), lambda x: regexp_replace(x, '^[ \t]*[(\[]?(?:[A-Za-z]|[0-9]{1,2})[.):\]][ \t]+', '')) END) AS o FROM data_input)"""
OPT = "array_to_string(list_transform(o, lambda x, i: (i - 1) || {s} || x), chr(10))"


@query(f"""WITH {OPTIONS} SELECT entry_id, {STRIP.format(x='question')} || chr(10) || {OPT.format(s="') '")} AS lvb, {STRIP.format(x='question')} || chr(10) || {OPT.format(s="' '")} AS mlvu,
'Question: ' || {STRIP.format(x='question')} || chr(10) || array_to_string(o, chr(10)) AS videomme, {OPT.format(s="'. '")} AS eval, CASE WHEN o IS NOT NULL THEN array_to_string(list_slice(list_concat(o, ['', '', '', '', '']), 1, 5), ';') END AS padded FROM o""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and option texts of each dataset's style, options of any notation padded to five."""
    from framewise.operators.dataset import padded

    rows = table(spark, d, "data_input").withColumn("o", T.option_list(F.col("options")))
    p = lambda name: T.prompt_text(F.col("question"), F.col("o"), name).alias(name)
    return rows.select("entry_id", p("lvb"), p("mlvu"), p("videomme"), T.option_lines(F.col("o"), "dot").alias("eval"), F.array_join(padded(F.col("o")), ";").alias("padded"))


MESSAGES = "m AS (SELECT coalesce(video_id, 'none') AS qid, doc_id % 3 AS pass_idx, doc_id, replace(text, '</search>', '</search><|image_pad|> window_indices=[' || doc_id % 6 || ', ' || doc_id % 4 || ']') AS content FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {MESSAGES}, r AS (SELECT qid, pass_idx, len(regexp_extract_all(content, '<(search|search_subtitle|search_summary)>')) AS calls, len(regexp_extract_all(content, '<\\|image_pad\\|>')) AS images FROM m),
p AS (SELECT qid, pass_idx, sum(calls) AS calls, sum(images) AS images FROM r GROUP BY 1, 2),
w AS (SELECT qid, count(DISTINCT x) AS windows FROM (SELECT qid, unnest(string_split(replace(y, ' ', ''), ',')) AS x FROM (SELECT qid, unnest(regexp_extract_all(content, 'window_indices=\\[([0-9, ]*)\\]', 1)) AS y FROM m)) GROUP BY 1)
SELECT qid, CAST(sum(calls) AS BIGINT) AS calls, CAST(max(images) AS BIGINT) AS images, coalesce(max(windows), 0) AS windows FROM p LEFT JOIN w USING (qid) GROUP BY 1""")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    """Calls, images and windows used by a question."""
    n = F.col("doc_id")
    extra = F.concat(F.lit("</search><|image_pad|> window_indices=["), (n % 6).cast("string"), F.lit(", "), (n % 4).cast("string"), F.lit("]"))
    m = table(spark, d, "documents").where("text is not null").select(F.coalesce("video_id", F.lit("none")).alias("qid"), (n % 3).alias("pass_idx"), F.replace("text", F.lit("</search>"), extra).alias("content"))
    return trajectory.tool_usage(m, "qid")


@query("SELECT 'f' || doc_id % 4 AS name, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def tool_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Called functions by name."""
    m = docs(spark, d).select(F.concat("text", F.lit("<tool_call> f"), (F.col("doc_id") % 4).cast("string"), F.lit("(a=1)</tool_call>")).alias("content"))
    return trajectory.tool_histogram(m)


TURN = "replace(replace(text, '</search>', '</search><tool_response><|vision_start|><|image_pad|><|vision_end|></tool_response>'), '</search_subtitle>', '</search_subtitle><tool_response><|vision_start|><|image_pad|><|image_pad|><|vision_end|></tool_response>')"
CLEAN = STRIP.format(x="regexp_replace(regexp_replace(span, '<\\|(?:vision_start|vision_end|image_pad)\\|>', '', 'g'), '\\s+', ' ', 'g')")


@query(f"""WITH t AS (SELECT doc_id, string_split({TURN}, '</tool_response>') AS parts FROM documents WHERE text IS NOT NULL AND kind = 'reasoning'),
p AS (SELECT doc_id, len(parts) AS m, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM t),
e AS (SELECT doc_id, i, 'images' AS kind, part AS span, substr(part, instr(part, '<tool_response>')) AS body FROM p WHERE i < m AND contains(part, '<tool_response>')
 UNION ALL SELECT doc_id, i, 'answer', list_extract(regexp_extract_all(part, '(?s)(.*?</answer>)', 1), 1), list_extract(regexp_extract_all(part, '(?s)<answer>(.*?)</answer>', 1), 1) FROM p WHERE i = m AND contains(part, '</answer>')),
c AS (SELECT *, {CLEAN} AS clean FROM e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS turn, kind, CASE WHEN kind = 'images' THEN len(regexp_extract_all(body, '<\\|image_pad\\|>')) END AS images, CASE WHEN kind = 'images' THEN len(regexp_extract_all(body, '<\\|vision_start\\|>')) END AS vision_blocks,
{STRIP.format(x="regexp_replace(clean, '(?s)<think>.*?</think>', '', 'g')")} AS said,
coalesce({STRIP.format(x="regexp_replace(list_extract(regexp_extract_all(clean, '(?s)(<search>.*?</search>|<search_summary>.*?</search_summary>|<search_subtitle>.*?</search_subtitle>)', 1), -1), '</?(search|search_summary|search_subtitle)>', '', 'g')")}, '') AS tool,
CASE WHEN kind = 'answer' THEN {STRIP.format(x='body')} END AS answer FROM c""")
def trajectory_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a trajectory with what was said, called and answered."""
    a = F.lit("</search><tool_response><|vision_start|><|image_pad|><|vision_end|></tool_response>")
    b = F.lit("</search_subtitle><tool_response><|vision_start|><|image_pad|><|image_pad|><|vision_end|></tool_response>")
    rows = docs(spark, d).where("kind = 'reasoning'").withColumn("text", F.replace(F.replace("text", F.lit("</search>"), a), F.lit("</search_subtitle>"), b))
    t = trajectory.turns(rows, "doc_id", "text")
    return t.select("doc_id", F.col("turn").cast("long").alias("turn"), "kind", F.col("images").cast("long").alias("images"), F.col("vision_blocks").cast("long").alias("vision_blocks"), "said", "tool", "answer")


@query("SELECT doc_id, CASE WHEN kind = 'question' THEN '' ELSE 'a' || doc_id || chr(10) || 'b' END AS content_text, CASE WHEN kind = 'question' THEN 0 ELSE (doc_id % 3)::INT END AS image_count FROM documents")
def compact_messages(spark: SparkSession, d: str) -> DataFrame:
    """Text and image count of message contents."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    images = F.array_repeat(part("image_url", F.lit(None).cast("string")), (F.col("doc_id") % 3).cast("int"))
    content = F.concat(F.array(part("text", F.concat(F.lit("a"), F.col("doc_id").cast("string")))), images, F.array(part("text", F.lit("b ")), part("audio", F.lit("c"))))
    content = F.when(F.col("kind") == "question", F.array().cast("array<struct<type:string,text:string>>")).otherwise(content)
    return table(spark, d, "documents").select("doc_id", T.message_text(content).alias("content_text"), T.message_images(content).alias("image_count"))
