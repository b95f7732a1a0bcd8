"""Readers and writers; one row per document, bad records set aside."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import collapse_newlines, strip


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, file_id, extension, raw) of every file; file_id is the md5 of the bytes."""
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("name"), F.md5("content").alias("file_id"), F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)).alias("extension"), F.col("content").alias("raw"))


def text_documents(files: DataFrame) -> DataFrame:
    """(file_id, name, page_content) of txt, html and json files; other extensions are left to ``unsupported``."""
    body = F.decode("raw", "UTF-8")
    plain = strip(collapse_newlines(body))
    markup = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</\1>", ""), r"(?s)<[^>]+>", "")
    content = F.when(F.col("extension") == "txt", plain).when(F.col("extension").isin("html", "htm"), strip(collapse_newlines(markup))).when(F.col("extension") == "json", F.to_json(F.try_parse_json(body)))
    return files.select("file_id", "name", content.alias("page_content")).where("page_content IS NOT NULL")


def unsupported(files: DataFrame) -> DataFrame:
    return files.where(~F.col("extension").isin("txt", "html", "htm", "json")).select("file_id", "name", "extension")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Records and, unless ``strict``, the lines that are none; blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST"), None
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record"), parsed.where("r._corrupt_record IS NOT NULL").select("value")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns become null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name) if kind in ("double", "float") else c)
    return df.select(*out)


def upsert_records(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def raw_documents(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Files from (name, raw) rows, as ``read_files`` gives them."""
    return rows.select("name", F.md5("raw").alias("file_id"), F.lower(F.regexp_extract("name", r"\.(\w+)$", 1)).alias("extension"), "raw")


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One JSON array in parts that read as one text: each task writes lines, the first and last carry the brackets."""
    lines = df.select(F.col(order).alias("_o"), F.to_json(F.struct("*")).alias("line"))
    top = lines.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi"))
    framed = lines.join(F.broadcast(top)).select("_o", F.concat(F.when(F.col("_o") == F.col("lo"), "[").otherwise(""), "line", F.when(F.col("_o") == F.col("hi"), "]").otherwise(",")).alias("value"))  # one row
    framed.repartitionByRange("_o").sortWithinPartitions("_o").select("value").write.mode("overwrite").text(path)


def versioned_write(df: DataFrame, path: str, version: int) -> str:
    """Writes a version of a table beside the others, so that the one before stays as its backup; gives its path."""
    target = f"{path}/v{version:06d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def exports(df: DataFrame, target: str) -> DataFrame:
    """(json) lines of (id, text, meta) in the form of a labelling or search tool."""
    forms = {
        "dict": lambda: F.struct("id", "text"),
        "prodigy": lambda: F.struct("text", F.struct("id").alias("meta")),
        "label_studio": lambda: F.struct(F.struct("text", F.col("id").alias("ref_id")).alias("data")),
        "label_box": lambda: F.struct(F.col("id").alias("externalId"), F.col("text").alias("data")),
        "baseplate": lambda: F.struct(F.struct("text").alias("data"), F.struct("id").alias("metadata")),
        "datasaur": lambda: F.struct("text", F.array().cast("array<string>").alias("entities")),
        "weaviate": lambda: F.struct("text", F.col("id").cast("string").alias("element_id")),
    }
    if target not in forms:
        raise ValueError(f"unknown target {target!r}")
    return df.select("id", F.to_json(forms[target]()).alias("json"))


def _html_text(html):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style") and self.skip > 0

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    parser = Text()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.parts).strip()


def html_text(html):
    """The text nodes of a page, scripts and styles left out, newlines collapsed."""
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(_html_text)

    return collapse_newlines(run(html))


def _office_rows(name, raw):
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if "word/document.xml" in names:
            root = ET.fromstring(z.read("word/document.xml"))
            for i, p in enumerate(e for e in root.iter() if tag(e) == "p"):
                yield (name, "", i + 1, 1, "".join(t.text or "" for t in p.iter() if tag(t) == "t"))
            return
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if tag(si) == "si"]
        for sheet in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            for c in (e for e in ET.fromstring(z.read(sheet)).iter() if tag(e) == "c"):
                value = next((v.text or "" for v in c.iter() if tag(v) in ("v", "t")), "")
                ref = c.get("r", "A1")
                letters = "".join(ch for ch in ref if ch.isalpha())
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch.upper()) - 64
                yield (name, sheet.rsplit("/", 1)[-1][:-4], int(ref[len(letters) :]), col, shared[int(value)] if c.get("t") == "s" else value)


def office_cells(files: DataFrame) -> DataFrame:
    """(name, sheet, row, col, value) of xlsx cells and docx paragraphs of files (name, raw); files that can't be read have one row of null value."""
    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch["name"], batch["raw"], strict=True):
                try:
                    rows += list(_office_rows(name, bytes(raw)))
                except Exception:  # noqa: BLE001 - any broken archive is a bad record
                    rows.append((name, None, 0, 0, None))
            yield pd.DataFrame(rows, columns=["name", "sheet", "row", "col", "value"])

    return files.select("name", "raw").mapInPandas(run, "name string, sheet string, row int, col int, value string")


def zip_chats(files: DataFrame) -> DataFrame:
    """(name, chat, roles, place, message) of JSON chats in zip files (name, raw): the values of their message_<n> keys; chats that lack a role are left out."""
    def run(batches):
        import io
        import json
        import zipfile

        for batch in batches:
            rows = []
            for name, raw in zip(batch["name"], batch["raw"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for inner in sorted(n for n in z.namelist() if n.endswith(".json")):
                        chat = json.loads(z.read(inner))
                        roles = sorted(k for k in chat if k.startswith("role_"))
                        if len(roles) == 2:
                            rows += [(name, inner, "_".join(str(chat[r]) for r in roles), int(k[8:]), str(v)) for k, v in chat.items() if k.startswith("message_")]
            yield pd.DataFrame(rows, columns=["name", "chat", "roles", "place", "message"])

    return files.select("name", "raw").mapInPandas(run, "name string, chat string, roles string, place int, message string")


def sheets(cells: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(name, sheet) of the sheets that hold cells, without those named in ``skip``."""
    return cells.where(F.col("sheet").isNotNull() & ~F.lower("sheet").isin(*skip)).select("name", "sheet").distinct()


def load_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet of all paths as one; the first that can't be read raises with its place."""
    for at, path in enumerate(paths):
        try:
            spark.read.parquet(path)
        except Exception as e:
            raise ValueError(f"source {at} can't be read: {path}") from e
    return spark.read.parquet(*paths)


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def newest_version(spark: SparkSession, path: str) -> str:
    """The path of the last version by name."""
    fs, target = _fs(spark, path)
    return max(s.getPath().toString() for s in fs.listStatus(target) if s.isDirectory())


def present(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(name, present): whether a folder holds each of the required files."""
    rows = []
    for name in names:
        fs, target = _fs(spark, f"{path}/{name}")
        rows.append((name, bool(fs.exists(target))))
    return spark.createDataFrame(rows, "name string, present boolean")
