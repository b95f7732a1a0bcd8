"""Chunkers: titles, markdown sections, code; elements of plain text."""

import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip


def elements(docs: DataFrame) -> DataFrame:
    """(id, i, kind, text): paragraphs as Title, ListItem or NarrativeText."""
    parts = docs.select("id", F.posexplode(F.split("text", r"\n\s*\n|\n")).alias("i", "text")).withColumn("text", strip(F.col("text"))).where("text <> ''")
    kind = F.when(F.rlike("text", F.lit(r"^(?:[-*\x{2022}]|\d+[.)])\s+")), "ListItem").when((F.length("text") <= 60) & ~F.rlike("text", F.lit(r"[.,;:!?]$")), "Title").otherwise("NarrativeText")
    return parts.select("id", "i", kind.alias("kind"), "text")


def title_chunks(docs: DataFrame, most: int = 500) -> DataFrame:
    """(id, chunk, text): paragraphs in order, a chunk ending before a title and where it would exceed ``most`` characters; longer ones are cut.

    The running size and the chunk number are one fold over a document's own paragraphs.
    """
    cut = elements(docs).select("id", "i", "kind", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / most).cast("int")), lambda j: F.substring("text", j * most + 1, F.lit(most)))).alias("j", "t"))
    rows = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "j", "kind", "t"))).alias("p"))
    zero = F.array().cast("array<struct<text:string,size:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        fresh = (F.size(done) == 0) | ((x.kind == "Title") & (x.j == 0)) | (F.coalesce(last["size"], F.lit(0)) + 1 + F.length(x.t) > most)
        one = F.struct(x.t.alias("text"), F.length(x.t).alias("size"))
        joined = F.struct(F.concat_ws("\n", last["text"], x.t).alias("text"), (last["size"] + 1 + F.length(x.t)).alias("size"))
        return F.when(fresh, F.concat(done, F.array(one))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    chunks = rows.select("id", F.aggregate("p", zero, add).alias("c"))
    return chunks.select("id", F.posexplode("c").alias("chunk", "c")).select("id", "chunk", "c.text")


def _sections(text, least, most):
    parts = [p for p in re.split(r"(?m)^(?=#{1,6} )", text or "") if p.strip()]
    merged: list[str] = []
    for p in parts:
        if merged and len(p.strip()) < least:
            merged[-1] += p
        else:
            merged.append(p)
    out = []
    for p in merged:
        now = ""
        for para in re.split(r"\n\s*\n", p) if len(p) > most else [p]:
            if now and len(now) + 2 + len(para) > most:
                out.append(now.strip())
                now = ""
            now = f"{now}\n\n{para}" if now else para
        out.append(now.strip())
    return [x for x in out if x]


def markdown_sections(text: Column, least: int = 50, most: int = 3000) -> Column:
    """Sections of a text by headings; those under ``least`` characters join the one before, those over ``most`` are split at paragraphs."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(lambda t: _sections(t, least, most))

    return run(text)


# Lines that begin a definition, and lines that begin with an image.
STRUCTURE = re.compile(r"^\s*(?:(def|class|function)\s+\w+|(public|private|protected)\s+[\w<>]+\s+\w+\s*\(|\b(interface|enum|namespace)\s+\w+|#\s*(region|endregion)\b)")
IMAGE = re.compile(r"!\[.*?\]\((?:data:image/[^;]+;base64,[a-zA-Z0-9+/]+=*|[^)]+)\)")


def _units(lines, tokens):
    """(lines, cost, alone) of what is not taken apart: a line before the first definition, a definition with what follows it, or a piece of an oversized line."""
    held, cost, opened = [], 0, False
    for line in lines:
        own = len(line) // 4 + 1
        starts = bool(STRUCTURE.match(line))
        if held and (starts or not opened or own > tokens):
            yield held, cost, False
            held, cost = [], 0
        if own > tokens:
            opened = False
            for at in range(0, len(line), tokens * 4):
                yield [line[at : at + tokens * 4]], tokens, True
            continue
        opened = opened or starts
        held.append(line)
        cost += own
    if held:
        yield held, cost, False


def _code_chunks(text, tokens, images, early):
    out, now, used = [], [], 0
    kept = (line for line in (text or "").split("\n") if images or not IMAGE.match(line))
    for lines, cost, alone in _units(kept, tokens):
        if now and (alone or used + cost > tokens or (used >= early * tokens and STRUCTURE.match(lines[0]))):
            out.append("\n".join(now))
            now, used = [], 0
        if alone:
            out.append(lines[0])
        else:
            now += lines
            used += cost
    if now:
        out.append("\n".join(now))
    return [x for x in out if x.strip()]


def code_chunks(text: Column, tokens: int = 8192, images: bool = False, early: float = 1.0) -> Column:
    """Chunks of about ``tokens`` tokens (4 characters each, and one a line) of a text's lines, in their order.

    A definition, with all lines up to the next, stays whole: it joins the chunk where it fits, else it begins one, and if it is larger than ``tokens`` it is
    one chunk of its own size. A single line above ``tokens`` is cut into pieces, each a chunk, and ends the definition around it. Lines that start with an
    image are dropped unless ``images``. A definition also begins a chunk once the one before is filled to the share ``early``. Null and blank texts have no chunks.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(lambda t: _code_chunks(t, tokens, images, early))

    return run(text)


def labelled_instances(text: Column) -> Column:
    """array<struct<input, label>> of a classification answer: each "Class label:" line and the lines after it."""
    parts = F.filter(F.split(text, r"(?m)^Class label:\s*"), lambda p: strip(p) != "")
    return F.transform(parts, lambda p: F.struct(strip(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"^Input:\s*", "")).alias("input"), strip(F.substring_index(p, "\n", 1)).alias("label")))


def generated_instances(text: Column) -> Column:
    """array<struct<input, output>> of a generation answer: each "Example" block with its "Output:" line."""
    parts = F.filter(F.split(text, r"(?m)^Example \d+\n?"), lambda p: F.contains(p, F.lit("Output:")))
    return F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "Output:", 1)).alias("input"), strip(F.substring_index(p, "Output:", -1)).alias("output")))
