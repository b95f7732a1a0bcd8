"""Column functions that read structure out of text: calls, tables, templates, labels, literals."""

import ast
import json
from typing import Callable, Iterator, Tuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip

#: Command prefixes that a query may name, tried in this order.
COMMAND_PATTERNS = (
    r"\b(slb\s+virtual\s+\w+)",
    r"\b(slb\s+real\s+\w+)",
    r"\b(slb\s+health\s*)",
    r"\b(slb\s+group\s+\w+)",
    r"\b(slb\s+policy\s+\w+)",
    r"\b(slb\s+\w+)",
    r"\b(llb\s+\w+)",
    r"\b(health\s+\w+)",
    r"\b(http2\s+\w+)",
    r"\b(show\s+slb\s+\w+)",
    r"\b(show\s+\w+)",
    r"\b(ip\s+\w+)",
    r"\b(no\s+\w+)",
)
#: What file names and contents say about a document's class, in order of precedence.
NAME_CLASSES = (
    (r"test.*list|测试.*列表|测试.*清单", "test/test_list"),
    (r"test.*template|测试.*模板|用例.*模板", "test/test_template"),
    (r"test.*strateg|test.*plan|测试.*策略|测试.*计划", "test/test_strategy"),
    (r"func.*spec|功能.*规格|sw.*functional", "spec/func_spec"),
    (r"prd|product.*require|产品.*需求", "spec/prd"),
    (r"design|设计.*文档|sw.*design|软件.*设计", "spec/design"),
)
CONTENT_CLASSES = (
    ("spec/func_spec", ("Function Specification", "Testing Consideration", "功能规格", "Definitions", "SW Functional Specification")),
    ("spec/prd", ("Product Requirement", "产品需求", "PRD", "需求说明")),
    ("spec/design", ("Software Design", "设计文档", "Design Document", "架构设计")),
    ("test/test_list", ("Test Types", "Expected Result", "Sub Item", "Test Build", "测试类型", "期望结果")),
    ("test/test_strategy", ("Test Strategy", "测试策略", "Test Plan", "测试计划")),
    ("test/test_template", ("XXX子功能", "YYY子功能", "测试用例模板")),
)
#: Results that admit a failure, and how they begin.
FAILURE_PHRASES = ("i cannot complete", "i cannot do", "task failed", "unable to complete", "cannot be completed", "failed to complete", "i cannot", "not possible", "impossible to", "cannot perform")
FAILURE_STARTS = ("error", "failed", "cannot", "unable")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def chunk_clean(text: Column) -> Column:
    """Joins words hyphenated over white space, collapses white space and drops what can't be printed."""
    joined = F.regexp_replace(text, r"(\w+)-\s+(\w+)", "$1$2")
    return F.regexp_replace(F.trim(F.regexp_replace(joined, r"\s+", " ")), r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", "")


def first_rule(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: str | None = None) -> Column:
    """The name of the first rule of which the lower-cased text contains a word."""
    low, out = F.lower(text), F.lit(default)
    for name, words in reversed(rules):
        out = F.when(hits(low, tuple(w.lower() for w in words)) > 0, F.lit(name)).otherwise(out)
    return out


def all_rules(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The names of all rules of which the lower-cased text contains a word, in order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(hits(low, tuple(w.lower() for w in words)) > 0, F.lit(name)) for name, words in rules]))


def best_rule(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The name of the rule with most words in the lower-cased text (ties: the first); null if none has any."""
    low = F.lower(text)
    scored = F.array(*[F.struct(hits(low, tuple(w.lower() for w in words)).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)])
    top = F.array_max(scored)
    return F.when(top.n > 0, top["name"])


def classify_document(name: Column, content: Column) -> Column:
    """struct(class, confidence): by file name 0.9; a workbook named test 0.8; two content words 0.7; workbook 0.4; Word file 0.3; else unknown, 0."""
    low, content = F.lower(name), F.lower(content)
    found = [F.struct(hits(content, tuple(w.lower() for w in words)).alias("n"), F.lit(-i).alias("place"), F.lit(kind).alias("name")) for i, (kind, words) in enumerate(CONTENT_CLASSES)]
    best = F.array_max(F.array(*found))
    pair = lambda kind, sure: F.struct(kind.alias("class"), F.lit(sure).alias("confidence"))
    book, letter = F.rlike(low, F.lit(r"\.xlsx?$")), F.rlike(low, F.lit(r"\.docx?$"))
    out = F.when(book & F.rlike(low, F.lit("test|测试|check|验证")), pair(F.lit("test/test_list"), 0.8))
    out = out.when(best.n >= 2, pair(best["name"], 0.7)).when(book, pair(F.lit("test/test_list"), 0.4)).when(letter, pair(F.lit("spec/func_spec"), 0.3)).otherwise(pair(F.lit("unknown"), 0.0))
    for pattern, kind in reversed(NAME_CLASSES):
        out = F.when(F.rlike(low, F.lit(pattern)), pair(F.lit(kind), 0.9)).otherwise(out)
    return out


def heading_level(title: Column) -> Column:
    """Depth of a section number such as 2.3.1; 1 for a numbered chapter, 0 without number."""
    number = F.regexp_extract(title, r"^((?:\d+\.)+\d*)", 1)
    parts = F.size(F.filter(F.split(number, r"\."), lambda x: x != ""))
    return F.when(number != "", parts).when(F.rlike(title, F.lit(r"^第\d+[章节]")), 1).otherwise(0)


def strip_heading(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"^(?:\d+\.)+\d*\s*", ""), r"^第\d+[章节]\s*", ""))


def markdown_rows(text: Column) -> Column:
    """Rows of trimmed cells of the table lines of a text; separator lines are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")) & ~F.rlike(x, F.lit(r"^[|\s:-]+$")))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def header_line(text: Column, words: tuple[str, ...], first: int = 10, least: int = 3) -> Column:
    """Place, from 0, of the first of the ``first`` lines that contains ``least`` of the words; -1 if none does."""
    lines = F.slice(F.split(F.lower(text), "\n"), 1, first)
    return (F.array_position(F.transform(lines, lambda x: hits(x, words) >= least), True) - 1).cast("int")


def complexity(qa: Column) -> Column:
    """Mean over question-answer structs (question, answer, steps, facts) of four capped shares; 0 without any."""
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    share = lambda n, most: F.least(n / F.lit(float(most)), F.lit(1.0))
    each = F.transform(qa, lambda x: 0.4 * share(x.steps, 3) + 0.3 * share(x.facts, 3) + 0.15 * share(words(x.question), 20) + 0.15 * share(words(x.answer), 50))
    return F.when(F.size(qa) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(qa)).otherwise(0.0)


def render_alpaca(instruction: Column, input_text: Column, output: Column) -> Column:
    middle = F.when(F.coalesce(input_text, F.lit("")) != "", F.concat(F.lit("\n\n### Input:\n"), input_text)).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), instruction, middle, F.lit("\n\n### Response:\n"), output)


def parse_alpaca(text: Column) -> Column:
    """struct(instruction, input, output), or null where a section is missing."""
    plain = F.replace(F.trim(text), F.lit("\r\n"), F.lit("\n"))
    part = lambda name: F.trim(F.regexp_replace(F.regexp_extract(plain, rf"(?s)###\s*{name}:\s*\n(.+?)(?=\n###|\z)", 1), r"^\s+|\s+$", ""))
    return F.when((part("Instruction") != "") & (part("Response") != ""), F.struct(part("Instruction").alias("instruction"), part("Input").alias("input"), part("Response").alias("output")))


NODE = r"Node\(id='(.*?)', type='(.*?)'\)"
RELATION = r"Relationship\(subj=Node\(id='(.*?)', type='(.*?)'\), obj=Node\(id='(.*?)', type='(.*?)'\), type='(.*?)'(?:, timestamp='(.*?)')?\)"


def graph_nodes(text: Column) -> Column:
    """array<struct<id, type>> in order; the first type of an id counts."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(NODE), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(NODE), F.lit(2)).alias("type"))
    ids = F.regexp_extract_all(text, F.lit(NODE), F.lit(1))
    return F.filter(pairs, lambda x, i: F.array_position(ids, x["0"]) == i + 1)


def graph_relations(text: Column) -> Column:
    """array<struct<subj, obj, type>> whose ends are nodes of the text."""
    ids = F.regexp_extract_all(text, F.lit(NODE), F.lit(1))
    group = lambda i: F.regexp_extract_all(text, F.lit(RELATION), F.lit(i))
    found = F.zip_with(F.zip_with(group(1), group(3), lambda s, o: F.struct(s.alias("subj"), o.alias("obj"))), group(5), lambda e, t: F.struct(e.subj.alias("subj"), e.obj.alias("obj"), t.alias("type")))
    return F.filter(found, lambda x: F.array_contains(ids, x.subj) & F.array_contains(ids, x.obj))


def tasks(text: Column) -> Column:
    """The contents of all <task> elements, trimmed; an open one at the end isn't a task yet."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<task>(.*?)</task>"), F.lit(1)), lambda x: strip(x))


def fences(text: Column) -> Column:
    """array<struct<kind, lang, body>>: text and fenced code in turn; blank text is left out."""
    parts = F.transform(F.split(text, "```"), _fence)
    return F.filter(parts, lambda p: (p.kind == "code") | (p.body != ""))


def _fence(x: Column, i: Column) -> Column:
    code = i % 2 == 1
    body = F.when(code, F.regexp_replace(x, r"^[^\n]*\n?", "")).otherwise(x)
    return F.struct(F.when(code, "code").otherwise("text").alias("kind"), F.when(code, F.trim(F.substring_index(x, "\n", 1))).otherwise("").alias("lang"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def personas(text: Column) -> Column:
    """array<struct<name, description>> of a numbered list of personas."""
    pattern = F.lit(r"persona_name:\s*(.*?)\s*;\s*persona_description:\s*([^\n]*)")
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.struct(a.alias("name"), b.alias("description")))


def api_call(text: Column) -> Column:
    """The first [Name(arguments)] of a text, or null."""
    return F.nullif(F.regexp_extract(text, r"\[(\w+)\((.*)\)\]", 0), F.lit(""))


def command_prefixes(query: Column) -> Column:
    """What the patterns find in the lower-cased query; without any, its first two words and its first."""
    low = F.lower(F.trim(query))
    found = F.array_compact(F.array(*[F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in COMMAND_PATTERNS]))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    some = F.array_compact(F.array(F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")), F.get(words, F.lit(0))))
    return F.when(F.size(found) > 0, found).otherwise(some)


def inline_header(text: Column, mark: str = "META_JSON:") -> Column:
    """struct(header, body): the JSON object after ``mark`` on the first line, as text if it parses, and what follows."""
    raw = F.regexp_extract(text, rf"^{mark}(\{{.*\}})", 1)
    header = F.when(F.try_parse_json(raw).isNotNull() & (raw != ""), raw)
    return F.struct(header.alias("header"), F.when(header.isNotNull(), F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text).alias("body"))


def value_and_unit(text: Column) -> Column:
    """struct(value, unit): the unit is a last part in dollar signs, or the last word."""
    latex = F.regexp_extract(text, r"\s(\$[^$]*\$)$", 1)
    parts = F.split(text, " ")
    last = F.element_at(parts, -1)
    value = F.when(last == "", F.trim(text)).when(latex != "", F.trim(F.regexp_replace(text, r"\s\$[^$]*\$$", ""))).when(F.size(parts) == 1, text).otherwise(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " "))
    unit = F.when(last == "", "").when(latex != "", latex).when(F.size(parts) == 1, "").otherwise(last)
    return F.struct(value.alias("value"), unit.alias("unit"))


def clean_scientific(text: Column) -> Column:
    r"""Without enclosing dollar signs and \mathrm; a \times 10^{b} becomes aeb."""
    bare = F.trim(text)
    bare = F.when(F.rlike(bare, F.lit(r"(?s)^\$.*\$$")), F.trim(F.regexp_replace(bare, r"^\$|\$$", ""))).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(bare, r"([\d.]+)\s*\\times\s*10\^\{(\d+)\}", "$1e$2"), r"\\mathrm\{([^}]*)\}", "$1")


def hermes_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of the <tool_call> elements that parse, single quotes taken as double ones."""
    raw = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    parsed = F.transform(raw, lambda x: F.from_json(F.replace(x, F.lit("'"), F.lit('"')), "name string, arguments string"))
    return F.filter(parsed, lambda x: x["name"].isNotNull())


def hermes_format(name: Column, arguments: Column) -> Column:
    return F.concat(F.lit("<tool_call>\n{\"name\": \""), name, F.lit("\", \"arguments\": "), arguments, F.lit("}\n</tool_call>"))


def function_call(text: Column) -> Column:
    """struct(function, arguments) of the first <function=name>{json}</function>; null if there is none or it doesn't parse."""
    pattern = r"<function=(\w+)>(.*?)</function>"
    name, args = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when((name != "") & F.try_parse_json(args).isNotNull(), F.struct(name.alias("function"), args.alias("arguments")))


def short_lists(values: Column, most: int = 128) -> Column:
    """Null for a list of ``most`` or more values."""
    return F.when(F.size(values) < most, values)


def is_close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def seconds_between(first: Column, last: Column) -> Column:
    return (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(1e6)


def dates(text: Column) -> Column:
    """ISO dates and times with optional zone."""
    return F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?)?"), F.lit(0))


def valid_time_label(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")) & F.try_to_timestamp(text).isNotNull()


def valid_task(content: Column, least: int = 1, output: bool = True) -> Column:
    """Whether a task's content, or as ``output`` its result, is usable: long enough, and no admission of failure."""
    bare = F.regexp_replace(content, r"^\s+|\s+$", "")
    fine = F.coalesce((bare != "") & (F.length(bare) >= least), F.lit(False))
    if output:
        low = F.lower(bare)
        fine = fine & (hits(low, FAILURE_PHRASES) == 0)
        for start in FAILURE_STARTS:
            fine = fine & ~F.startswith(low, F.lit(start))
    return fine


def _boxed(text: str | None) -> str | None:
    at = (text or "").find("\\boxed{")
    if at < 0:
        return None
    depth, out, i = 1, [], at + 7
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(text[i : i + 2])
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        if not depth:
            return "".join(out).strip()
        out.append(c)
        i += 1
    return None


@F.pandas_udf(T.StringType())
def boxed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    r"""The content of the first \boxed{...} with balanced, unescaped braces; null if it isn't closed."""
    for text in batches:
        yield text.map(_boxed)


def _literal(text: str | None, kind: str) -> str | None:
    try:
        value = ast.literal_eval((text or "").strip().replace('\\"', '"'))
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return None
    if type(value).__name__ != kind:
        return None
    if kind == "dict":
        return repr(dict(sorted(value.items(), key=lambda x: str(x[0]))))
    ordered = sorted(value, key=str)
    return repr(ordered if kind == "list" else set(ordered) if kind == "set" else tuple(ordered))


def literal(text: Column, kind: str = "list") -> Column:
    """A Python list, dict, set or tuple literal in normal form (sorted by text); null for anything else."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(lambda t: _literal(t, kind))

    return run(text)


def _paired(left: list, right: list, near: Callable) -> bool:
    """Whether the members of two lists of one length can be paired so that all pairs are near: a matching is grown by exchange of partners."""
    partner: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, y in enumerate(right):
            if j not in tried and near(left[i], y):
                tried.add(j)
                if j not in partner or place(partner[j], tried):
                    partner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(left)))


def _near(a, b, tolerance: float) -> bool:
    near = lambda x, y: _near(x, y, tolerance)
    kinds = {type(a), type(b)}
    if kinds <= {int, float, bool}:
        return abs(a - b) <= tolerance
    if kinds == {dict}:
        return a.keys() == b.keys() and all(near(v, b[k]) for k, v in a.items())
    if kinds in ({list}, {tuple}, {set}) and len(a) == len(b):
        return _paired(list(a), list(b), near) if kinds == {set} else all(map(near, a, b))
    return a == b


def _near_texts(a: str | None, b: str | None, tolerance: float) -> bool | None:
    if a is None or b is None:
        return None
    try:
        return bool(_near(ast.literal_eval(a.strip()), ast.literal_eval(b.strip()), tolerance))
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError, OverflowError):
        return a.strip() == b.strip()


def near_literals(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two Python literals are equal but for numbers, which may differ by ``tolerance`` at any depth.

    Lists and tuples are compared in order, dictionaries by key, and sets if their members can be paired; a list is no tuple. Where either text is no
    literal the trimmed texts have to be equal. Null if either is null.
    """

    @F.pandas_udf(T.BooleanType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_near_texts(x, y, tolerance) for x, y in zip(left, right, strict=True)], dtype=object)

    return run(a, b)


def _json_like(snippet: str):
    for read in (json.loads, ast.literal_eval):
        try:
            return read(snippet)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None


def _tool_calls(text: str | None) -> list[str]:
    text, found, at = text or "", [], 0
    while (start := next((i for i in range(at, len(text)) if text[i] in "{["), -1)) >= 0:
        depth, quote, end = 0, "", -1
        for i in range(start, len(text)):
            c = text[i]
            if quote:
                quote = "" if c == quote and text[i - 1] != "\\" else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c in "{[") - (c in "}]")
                if not depth:
                    end = i + 1
                    break
        value = _json_like(text[start:end]) if end > 0 else None
        todo = value if isinstance(value, list) else [value]
        calls = [x for x in todo if isinstance(x, dict) and "tool_name" in x]
        found += [json.dumps(x, sort_keys=True) for x in calls]
        at = end if end > 0 and value is not None else start + 1
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def tool_calls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON texts of the objects of a text, fenced or not, that name a tool (``tool_name``), by JSON or Python literal rules."""
    for text in batches:
        yield text.map(_tool_calls)


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def rouge_l(batches: Iterator[Tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F measure of the longest common subsequence of two word lists; 0 if one is empty."""
    for a, b in batches:
        yield pd.Series([2 * _lcs(list(x), list(y)) / (len(x) + len(y)) if x is not None and y is not None and len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)])
