"""Asset files: one Markdown document with a key/value header per asset.

Files are read whole by executors and taken apart with array expressions.
Supported header shapes are ``key: value``, ``key: [a, b]``, a list of
scalars and a list of ``target`` / ``rel`` objects.  A header with any other
shape goes to the error table instead of being guessed at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakegraph import model
from lakegraph.functions.naming import stem_of
from lakegraph.functions.text import bundle_hrefs, let, settle, spread

_ENTRY = r"^([A-Za-z_][\w.-]*)\s*:(.*)$"
_NULLS = ("null", "Null", "~", "")
_BLANKS = (" ", "\t", "\n", "\x0b", "\f", "\r")


def scan_files(spark: SparkSession, root: str, glob: str = "*.md", *, streaming: bool = False) -> DataFrame:
    """``path, text`` of every file below ``root``; ``path`` is relative with a leading slash."""
    reader = spark.readStream.schema("value string") if streaming else spark.read
    files = (
        reader.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(root)
    )
    return files.select(relative_path(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))


#: Ends a record of a packed file; a text that holds it, or the mark, is written with the mark and a digit.
_RECORD, _MARK = "\x1e", "\x1d"


def _packed(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK), F.lit(_MARK + "0")), F.lit(_RECORD), F.lit(_MARK + "1"))


def _unpacked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_MARK + "1"), F.lit(_RECORD)), F.lit(_MARK + "0"), F.lit(_MARK))


def write_packed(assets: DataFrame, root: str, records_per_file: int = 1_000_000) -> None:
    """``path, text`` of many assets per file, as records of a path line and the text.

    A task writes one file for up to ``records_per_file`` assets, so the number of files follows
    the data and not the assets. A null text is an empty one; rows without a path are
    no assets and are refused.
    """
    path = F.replace(_packed(F.col("path")), F.lit("\n"), F.lit(_MARK + "2"))
    path = F.when(path.isNull(), F.raise_error(F.lit("an asset needs a path"))).otherwise(path)
    record = F.concat(path, F.lit("\n"), _packed(F.coalesce("text", F.lit(""))))
    (assets.select(record.alias("value")).write.option("lineSep", _RECORD)
     .option("maxRecordsPerFile", records_per_file).text(root))


def scan_packed(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of the assets below ``root`` that ``write_packed`` wrote; large files are read in splits."""
    records = spark.read.option("lineSep", _RECORD).option("recursiveFileLookup", True).text(root)
    head = F.substring_index("value", "\n", 1)
    return records.select(
        _unpacked(F.replace(head, F.lit(_MARK + "2"), F.lit("\n"))).alias("path"),
        _unpacked(F.substr("value", F.length(head) + 2)).alias("text"),
    )


def relative_path(file_path: Column, root: str) -> Column:
    """Path below ``root`` from the percent-encoded URI a scan reports.

    The folder is looked for once, from the left, so a path that repeats it further down keeps its whole tail.
    """
    folder = root.split("://", 1)[-1].rstrip("/")
    folder = folder.split(":", 1)[-1] if folder.startswith("file:") else folder
    decoded = F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit("/"), F.ltrim(
        F.substr(decoded, F.instr(decoded, folder + "/") + len(folder) + 1), F.lit("/")))


def is_asset_file(path: Column) -> Column:
    """Not the change log, the root index, a dot file or anything in the index folder."""
    name = F.substring_index(path, "/", -1)
    return (name != "log.md") & ~name.startswith(".") & (path != "/index.md") & ~path.contains("/.index/")


def unquote(value: Column) -> Column:
    def read(v: Column) -> Column:
        quoted = (F.length(v) >= 2) & (
            (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
        )
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        plain = F.when(F.contains(v, F.lit("\\")), F.regexp_replace(inner, r"\\([\"'\\])", "$1")).otherwise(inner)
        return F.when(quoted, plain).when(~v.isin(*_NULLS), v)

    return let(value, read)


def split_header(files: DataFrame) -> DataFrame:
    """``path, header, body`` of the files that have a header; line ends normalised.

    A header right below its mark ends before the next line that starts with the mark, which is looked for
    as it is. Others are left to the pattern; header and body are cut out by its length.
    """
    text = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", r"\r\n?", "\n")).otherwise(F.col("text"))
    plain = F.col("text").startswith("---\n") & ~F.substring("text", 5, 1).isin("", *_BLANKS)
    found = settle(files.select("path", text.alias("text")), at=F.when(plain, F.locate("\n---", F.col("text"), 5)))
    front = settle(found, front=F.when(F.col("at").isNull(), F.regexp_extract("text", model.FRONTMATTER, 0)))
    header = F.when(F.col("at").isNull(), F.regexp_extract("front", model.FRONTMATTER, 1)).otherwise(
        F.substr("text", F.lit(5), F.col("at") - 5))
    body = F.when(F.col("at").isNull(), F.substr("text", F.length("front") + 1)).otherwise(
        F.ltrim(F.substr("text", F.col("at") + 4), F.lit("".join(_BLANKS))))
    return front.filter(F.coalesce(F.col("at") > 0, F.col("front") != "")).select("path", header.alias("header"), body.alias("body"))


def parse_header(raw: DataFrame) -> DataFrame:
    """Adds ``entries`` (key, value, list lines), ``links``, ``bad_links`` and ``header_error``."""
    lines = F.filter(
        F.split("header", "\n"), lambda l: (F.trim(l) != "") & ~F.ltrim(l).startswith("#")
    )

    def entry(ls: Column, st: Column, s: Column, j: Column) -> Column:
        # A key holds no colon, so it ends before the first one; no line end but a last one follows it.
        line = F.element_at(ls, s)
        return let(F.substring_index(line, ":", 1), lambda key: F.struct(
            F.rtrim(key, F.lit("".join(_BLANKS))).alias("key"),
            F.trim(F.rtrim(F.substr(line, F.length(key) + 2), F.lit("\x85\u2028\u2029"))).alias("value"),
            F.slice(ls, s + 1, F.coalesce(F.get(st, j + 1), F.size(ls) + 1) - s - 1).alias("block"),
        ))

    def entries(ls: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ls)), lambda i: F.element_at(ls, i).rlike(_ENTRY)
        )
        found = let(starts, lambda st: F.transform(st, lambda s, j: entry(ls, st, s, j)))
        # The plain text of a value is read by many fields, so it is made here once.
        return F.transform(found, lambda e: F.struct(
            e["key"].alias("key"), e["value"].alias("value"), e["block"].alias("block"), unquote(e["value"]).alias("text")))

    shape = "array<struct<key:string,value:string,block:array<string>,text:string>>"
    found = let(lines, lambda ls: F.struct(
        F.when(F.size(ls) > 0, entries(ls)).otherwise(F.array().cast(shape)).alias("entries"),
        F.get(ls, F.lit(0)).rlike(_ENTRY).alias("opens"),
    ))
    # The last entry of a key wins; most headers have every key once.
    last = lambda es: F.when(F.size(F.array_distinct(es["key"])) == F.size(es), es).otherwise(
        F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda later: later["key"] == e["key"])))
    # One boundary: what follows are columns of their own, so a reader of a few leaves the rest uncomputed.
    settled = settle(raw, _head=let(found, lambda h: F.struct(last(h["entries"]).alias("entries"), h["opens"].alias("opens"))))
    parsed = settled.select(*raw.columns, F.col("_head.entries").alias("entries"), F.col("_head.opens").alias("opens"))
    # Keys are distinct now, so fields are looked up in a map.
    parsed = parsed.withColumn("by_key", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], e))))

    block = F.array_join(_entry("links", "block"), "\n")
    items = F.filter(F.split(block, r"(?m)^\s*-\s+"), lambda x: F.trim(x) != "")
    parsed = parsed.withColumn("items", items)
    is_object = lambda x: x.rlike(r"(?m)^\s*[\w-]+\s*:")
    field = lambda x, k: unquote(F.trim(F.regexp_extract(x, r"(?m)^\s*" + k + r"\s*:[ \t]*(.*)$", 1)))
    links = F.transform(
        F.filter("items", is_object),
        lambda x: F.struct(field(x, "target").alias("target"), field(x, "rel").alias("rel")),
    )
    inline = F.regexp_extract_all(_entry("links", "value"), F.lit(r"[^\[\],]+"), F.lit(0))
    bad = F.size(F.filter("items", lambda x: ~is_object(x))) + F.coalesce(
        F.when(_entry("links", "value").startswith("["), F.size(F.filter(inline, lambda x: F.trim(x) != ""))),
        F.lit(0),
    )
    unsupported = F.exists("entries", lambda e: e["value"].isin("|", ">")) | F.exists(
        "entries",
        lambda e: (e["key"] != "links") & F.exists(e["block"], lambda l: ~l.rlike(r"^\s*-\s")),
    ) | (~F.col("opens"))
    return parsed.withColumns({
        "links": F.coalesce(links, F.array().cast("array<struct<target:string,rel:string>>")),
        "bad_links": F.coalesce(bad, F.lit(0)),
        "header_error": F.when(F.size("entries") == 0, F.lit("empty header")).when(
            unsupported, F.lit("unsupported header shape")),
    }).drop("opens", "items")


def _entry(key: str, part: str) -> Column:
    return F.col("by_key")[key][part]


def scalar(key: str) -> Column:
    """Text of a scalar key; NULL when missing, empty or a null word."""
    return _entry(key, "text")


def text_list(key: str) -> Column:
    """Items of ``key: [a, b]`` or of a dashed list."""
    value, block = _entry(key, "value"), _entry(key, "block")
    inline = F.split(F.regexp_replace(value, r"^\[|\]$", ""), ",")
    dashed = F.transform(block, lambda l: F.regexp_replace(l, r"^\s*-\s+", ""))
    items = F.when(value.startswith("["), inline).otherwise(dashed)
    return F.filter(F.transform(items, lambda x: unquote(F.trim(x))), lambda x: x.isNotNull())


_CORE_STRINGS = ("type", "title", "description", "layer", "status", "wiki_key", "truth_state",
                 "owner", "author", "timestamp")
_CORE_KEYS = _CORE_STRINGS + ("verified", "generated", "tags", "links")


def _typed_fields() -> dict[str, Column]:
    """Columns that the operators read, from the keys an asset file may spell them with, first come first."""
    spelled = {"kind": ("source_kind", "kind"), "mode": ("ingestion_mode", "mode"), "fqn": ("fqn",), "uri": ("uri",),
               "source": ("source",), "name": ("name",)}
    return {name: F.coalesce(*[F.nullif(F.col("extra_fields")[k], F.lit("")) for k in keys]) for name, keys in spelled.items()}


def _text_of(entry: Column) -> Column:
    """Value as text; the lines of a list joined."""
    return F.coalesce(entry["text"], F.when(F.size(entry["block"]) > 0, F.array_join(entry["block"], "\n")))


def _kind_of(entry: Column) -> Column:
    """How a value was written: string, number, integer, boolean or array; NULL for nothing or a null word."""
    value = entry["value"]
    listed = value.startswith("[") | ((value == "") & (F.size(entry["block"]) > 0))
    return (
        F.when(listed, F.lit("array")).when(value.isin(*_NULLS), F.lit(None).cast("string"))
        .when(F.lower(value).isin("true", "false"), F.lit("boolean"))
        # What starts with no sign, point or digit is no number.
        .when(~F.ascii(value).between(43, 57), F.lit("string"))
        .when(value.rlike(r"^[-+]?[0-9]+$"), F.lit("integer"))
        .when(value.rlike(r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"), F.lit("number"))
        .otherwise(F.lit("string"))
    )


def read_concepts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(concepts, errors)`` of an asset folder; catalog listings are not assets."""
    files = scan_files(spark, root).filter(is_asset_file(F.col("path")))
    return parse_concepts(files)


def parse_concepts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = parse_header(split_header(spread(files)))
    errors = parsed.filter(F.col("header_error").isNotNull()).select("path", "header_error")
    extra = F.map_from_entries(F.transform(
        F.filter("entries", lambda e: ~e["key"].isin(*_CORE_KEYS)),
        lambda e: F.struct(e["key"], F.coalesce(
            e["text"], F.when(F.size(e["block"]) > 0, F.array_join(e["block"], "\n")), F.lit(""))),
    ))
    named = parsed.filter(F.col("header_error").isNull()).withColumns({
        "extra_fields": extra,
        "tag_list": text_list("tags"),
        **{f"_{k}": scalar(k) for k in (*_CORE_STRINGS, "verified", "generated")},
    })
    concepts = named.filter(F.coalesce(F.col("_type") != "Catalog", F.lit(True))).select(
        "path",
        F.split("path", "/")[1].alias("catalog"),
        stem_of(F.col("path")).alias("stem"),
        *[F.col(f"_{k}").alias(k) for k in _CORE_STRINGS],
        *[F.col(f"_{k}").try_cast("boolean").alias(k) for k in ("verified", "generated")],
        F.col("tag_list").alias("tags"),
        "links",
        "bad_links",
        *[field.alias(name) for name, field in _typed_fields().items()],
        F.transform("entries", lambda e: e["key"]).alias("keys"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], _text_of(e)))).alias("fields"),
        F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], _kind_of(e)))).alias("kinds"),
        F.size(F.filter("links", lambda l: F.coalesce(l["target"], F.lit("")) == "")).alias("untargeted_links"),
        F.col("extra_fields").alias("extra"),
        "body",
    )
    return concepts, errors


def explode_links(concepts: DataFrame) -> DataFrame:
    """``src, pos, target, rel`` with one row per header link."""
    return concepts.select(
        F.col("path").alias("src"), F.posexplode("links").alias("pos", "link")
    ).select("src", "pos", "link.target", "link.rel")


def body_links(docs: DataFrame, key: str, text: str, pattern: str = model.MARKDOWN_LINK, group: int = 2) -> DataFrame:
    """``key, href`` with one row per in-bundle link in a text column."""
    return docs.select(key, F.explode(bundle_hrefs(F.col(text), pattern, group)).alias("href"))
